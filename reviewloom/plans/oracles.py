"""The catalog's queries as DuckDB SQL, for the side-by-side check.

The rules are written out again in SQL: patterns with spelled word boundaries,
windows and joins where the operators use digests and cuts.
"""

# Fixed values, written out a second time, so that a slip in the operators' own lists shows.

LABELS = ("Negative", "Neutral", "Positive")

WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

STOP_WORDS = """
    a about above after again against all am an and any are aren't as at be because been before
    being below between both but by can't cannot could couldn't did didn't do does doesn't doing
    don't down during each few for from further had hadn't has hasn't have haven't having he he'd
    he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into
    is isn't it it's its itself let let's me more most mustn't my myself no nor not of off on once
    only or other ought our ours ourselves out over own same shan't she she'd she'll she's should
    shouldn't so some such than that that's the their theirs them themselves then there there's
    these they they'd they'll they're they've this those through to too under until up very was
    wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while
    who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
    yourself yourselves
""".split()

NEGATIONS = """
    no nor not never none neither cannot cant dont isnt didnt wasnt wouldnt shouldnt couldnt hasnt
    havent hadnt without can't don't isn't didn't wasn't wouldn't shouldn't couldn't hasn't haven't
    hadn't
""".split()

DROPPED_WORDS = [w for w in STOP_WORDS if w not in NEGATIONS]

PRODUCT_WORDS = """
    product item quality battery phone package delivery order seller purchase price support feature
    performance sound screen build material device unit software app service shipping box refund
    return warranty customer brand charge charger camera laptop book earphone headphone size color
    fit durability speed amazon store buy bought packaging value money cost deal discount
    merchandise goods hardware model working arrived defective
""".split()

PRODUCT_PHRASES = ["love this", "hate this", "recommend this"]

OUT_OF_DOMAIN = [
    r"feeling\s+(?:well|sick|bad|ill|good|better|terrible)",
    r"not\s+feeling\s+(?:well|good|ok|okay|great)",
    "headache",
    "fever",
    "stomach",
    "cough",
    "doctor",
    "hospital",
    "medicine",
    "sick",
    "illness",
    "pain",
    "weather",
    "raining",
    "sunny",
    "temperature",
    r"how\s+are\s+you",
    r"what\s+is\s+your\s+name",
    r"who\s+are\s+you",
    r"good\s+(?:morning|afternoon|evening|night)",
    r"capital\s+of",
    "president",
    r"prime\s+minister",
]

ACCEPTED = "Product Feedback Detected"
REJECTED = "Outside Product Feedback Domain"
EMPTY_MESSAGE = "Input text is empty. Please enter feedback about a product or service."
OFF_TOPIC_MESSAGE = (
    "This application is designed to analyze product/customer feedback. "
    "Please enter feedback about a product or service."
)
VERIFIED_MESSAGE = "Input verified as product/customer feedback domain."
TOO_SHORT_MESSAGE = (
    "Input does not clearly contain product feedback. "
    "Please enter a review or feedback related to a product or service."
)
ACCEPTED_MESSAGE = "Input accepted for product feedback analysis."

LEGACY_BASELINE = {
    "accuracy": 0.9162,
    "macro_precision": 0.5484,
    "macro_recall": 0.5897,
    "macro_f1": 0.5657,
    "weighted_f1": 0.9133,
    "f1_Negative": 0.6974,
    "f1_Neutral": 0.0408,
    "f1_Positive": 0.959,
}

KEYWORDS = ("the", "and", "les", "der", "with", "ing", "nowhere")

ORACLES = {}


def quoted(value):
    return "'" + str(value).replace("'", "''") + "'"


def strip(x):
    return f"trim({x}, {quoted(WHITESPACE)})"


def star(x):
    return (
        f"CASE WHEN {x} IN (1, 2) THEN 'Negative' WHEN {x} = 3 THEN 'Neutral' "
        f"WHEN {x} IN (4, 5) THEN 'Positive' ELSE 'Invalid' END"
    )


def replace(x, pattern, by):
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def expand(x):
    t = f"lower(coalesce({x}, ''))"
    t = replace(t, r"\bcan['’]t\b", "cannot")
    t = replace(t, r"\bwon['’]t\b", "will not")
    t = replace(t, r"\bshan['’]t\b", "shall not")
    return replace(t, r"([\p{L}\p{N}_])n['’]t([^\p{L}\p{N}_]|$)", r"\1 not\2")


def clean(x):
    t = replace(expand(x), r"<[^\n]*?>", " ")
    t = replace(t, r"http\S+|www\S+|https\S+", " ")
    t = replace(t, r"[^a-zA-Z\s]", " ")
    t = replace(t, r"\b[a-zA-Z]\b", " ")
    return f"trim({replace(t, r'\s+', ' ')})"


def tokens(x):
    return f"regexp_extract_all({clean(x)}, '[a-z]+')"


STOP_LIST = "[" + ", ".join(quoted(w) for w in DROPPED_WORDS) + "]"


def kept(x):
    return f"list_filter({x}, lambda t: NOT list_contains({STOP_LIST}, t) AND length(t) > 1)"


def lemmas(x):
    return (
        f"list_transform({x}, lambda t: CASE "
        "WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, length(t) - 3) "
        "WHEN t LIKE '%ed' AND length(t) > 4 THEN left(t, length(t) - 2) "
        "WHEN t LIKE '%es' AND length(t) > 4 THEN left(t, length(t) - 2) "
        "WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END)"
    )


def joined(x, by=" "):
    return f"array_to_string({x}, '{by}')"


def words(x):
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def gate_message(x):
    lower = f"lower({strip(f'coalesce({x}, {quoted("")})')})"

    def any_of(patterns):
        return quoted(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(patterns)})($|[^\p{{L}}\p{{N}}_])")

    distinct = (
        f"len(list_distinct(list_filter(regexp_extract_all({lower}, '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda w: regexp_full_match(w, '[a-z]{2,}'))))"
    )
    mention = f"regexp_matches({lower}, {any_of(PRODUCT_WORDS + PRODUCT_PHRASES)})"
    return (
        f"CASE WHEN {strip(f'coalesce({x}, {quoted("")})')} = '' THEN {quoted(EMPTY_MESSAGE)} "
        f"WHEN NOT {mention} AND regexp_matches({lower}, {any_of(OUT_OF_DOMAIN)}) THEN {quoted(OFF_TOPIC_MESSAGE)} "
        f"WHEN {mention} THEN {quoted(VERIFIED_MESSAGE)} "
        f"WHEN {distinct} < 3 THEN {quoted(TOO_SHORT_MESSAGE)} "
        f"ELSE {quoted(ACCEPTED_MESSAGE)} END"
    )


def accepted(message):
    return f"{message} IN ({quoted(VERIFIED_MESSAGE)}, {quoted(ACCEPTED_MESSAGE)})"


def reviews(products=97):
    return f"""reviews AS (
  SELECT doc_id AS review_id, concat(source, ':', CAST(doc_id % {products} AS VARCHAR)) AS product_id,
         concat('u', CAST(doc_id % 53 AS VARCHAR)) AS reviewer_id, CAST(1 + doc_id % 5 AS INTEGER) AS stars,
         text AS review_body, CASE WHEN doc_id % 61 <> 0 THEN split_part(text, '.', 1) END AS review_title,
         lang AS language, concat(lang, '-', CAST(doc_id % 3 AS VARCHAR)) AS product_category
  FROM documents)"""


def prepared(products=97):
    return f"""{reviews(products)},
prepared AS (
  SELECT * REPLACE ({strip("coalesce(review_title, '')")} AS review_title, {strip("coalesce(review_body, '')")} AS review_body),
         {star('stars')} AS sentiment
  FROM reviews)"""


SCORED = f"""{reviews()},
scored AS (
  SELECT *, {star('stars')} AS sentiment, {star('(1 + (review_id * 7 + review_id // 5) % 5)')} AS predicted_sentiment,
         round((review_id % 1000) / 10.0, 2) AS confidence
  FROM reviews)"""

LABELLED = f"""{reviews(7)},
labelled AS (
  SELECT r.*, CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive' ELSE 'Neutral' END AS sentiment
  FROM reviews r JOIN labels l ON r.review_id = l.doc_id)"""

CLEANED = f"""{prepared()},
groups AS (
  SELECT review_body, count(*) AS n, count(DISTINCT sentiment) AS n_labels, min(review_id) AS first_id
  FROM prepared GROUP BY review_body),
cleaned AS (
  SELECT p.* FROM prepared p JOIN groups g ON p.review_body = g.review_body
  WHERE g.n_labels = 1 AND p.review_id = g.first_id AND {strip('p.review_body')} <> '')"""

ODD_STARS = "CASE WHEN review_id % 11 <> 0 THEN CAST(review_id % 8 AS INTEGER) END"


def counts(column):
    return f"WITH {reviews()} SELECT {column}, count(*) AS n FROM reviews WHERE {column} IS NOT NULL GROUP BY {column}"


ORACLES["category_class_distribution"] = f"""WITH {CLEANED}
SELECT product_category, {', '.join(f"count(*) FILTER (sentiment = '{c}') AS {quoted(c).replace("'", '"')}" for c in LABELS)}
FROM cleaned GROUP BY product_category"""

ORACLES["csv_round_trip"] = f"""WITH {reviews()}
SELECT * REPLACE (CAST(review_id AS VARCHAR) AS review_id) FROM reviews"""

ORACLES["partitioned_write"] = f"""WITH {reviews()}
SELECT language, count(*) AS n, CAST(sum(stars) AS BIGINT) AS sum_stars FROM reviews GROUP BY language"""

ORACLES["report_round_trip"] = f"""WITH {reviews()}
SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns, count(DISTINCT review_id) AS distinct_reviews,
       count(DISTINCT product_id) AS distinct_products, count(*) - count(DISTINCT review_body) AS duplicate_bodies,
       count(review_title) - count(DISTINCT review_title) AS duplicate_titles FROM reviews"""

ORACLES["detected_text_column"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, 'text' AS text_column, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {t}"
    for t in ("documents", "benchmark", "conversations")
)

ORACLES["star_labels"] = f"""WITH {reviews()}
SELECT review_id, {star('stars')} AS sentiment, {star(f'({ODD_STARS})')} AS odd_sentiment FROM reviews"""

ORACLES["rating_labels"] = f"""WITH {reviews()}, rated AS (
  SELECT review_id, CASE WHEN review_id % 13 <> 0 THEN CAST(review_id % 11 AS DOUBLE) / 2 END AS rating FROM reviews)
SELECT review_id, rating, CASE WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral' ELSE 'Positive' END AS sentiment
FROM rated"""

ORACLES["normalized_texts"] = f"WITH {prepared()} SELECT review_id, review_title, review_body FROM prepared"

ORACLES["text_options"] = f"""WITH {reviews()}
SELECT review_id, md5(coalesce(review_body, '')) AS text_a,
       md5({strip("concat(coalesce(review_title, ''), ' ', coalesce(review_body, ''))")}) AS text_b FROM reviews"""

ORACLES["invalid_star_rows"] = f"""WITH {reviews()}, odd AS (SELECT review_id, {ODD_STARS} AS stars FROM reviews)
SELECT review_id, stars FROM odd WHERE stars IS NULL OR stars NOT IN (1, 2, 3, 4, 5)"""

ORACLES["correct_flags"] = f"WITH {SCORED} SELECT review_id, sentiment IS NOT DISTINCT FROM predicted_sentiment AS correct FROM scored"

_APOSTROPHES = replace("text", "(ent|ing|on)( )", r"n't\2")
ORACLES["expanded_contractions"] = f"""WITH texts AS (
  SELECT doc_id AS id, 'documents' AS source, text FROM documents
  UNION ALL SELECT page_id, 'pages', html FROM pages)
SELECT id, source, md5({expand('text')}) AS plain, md5({expand(_APOSTROPHES)}) AS contracted FROM texts"""

ORACLES["cleaned_documents"] = f"SELECT doc_id, {clean('text')} AS cleaned_text FROM documents"
ORACLES["cleaned_pages"] = f"SELECT page_id, {clean('html')} AS cleaned_html, {clean('url')} AS cleaned_url FROM pages"

ORACLES["token_lists"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents)
SELECT doc_id, len(tokens) AS n_tokens, md5({joined('tokens', ',')}) AS tokens FROM t"""

ORACLES["kept_tokens"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents),
k AS (SELECT doc_id, {kept('tokens')} AS kept FROM t)
SELECT doc_id, len(kept) AS n_kept, md5({joined('kept', ',')}) AS kept FROM k"""

ORACLES["suffix_lemmas"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents)
SELECT doc_id, {joined(lemmas('tokens'), ',')} AS lemmas FROM t"""

ORACLES["table_lemmas"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents)
SELECT doc_id, {joined("list_transform(tokens, lambda t: CASE WHEN t LIKE '%e' AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END)", ',')} AS lemmas FROM t"""

ORACLES["preprocessed_documents"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents)
SELECT doc_id, {joined(lemmas(kept('tokens')))} AS processed_text FROM t"""

ORACLES["text_steps"] = f"""WITH t AS (SELECT conv_id, turn, {clean('text')} AS cleaned_text, {tokens('text')} AS tokens FROM conversations),
k AS (SELECT *, {kept('tokens')} AS kept FROM t), l AS (SELECT *, {joined(lemmas('kept'))} AS lemmas FROM k)
SELECT conv_id, turn, cleaned_text, {joined('tokens')} AS tokens, {joined('kept')} AS filtered_tokens,
       lemmas AS lemmatized_tokens, lemmas AS processed_text, len(tokens) AS num_tokens FROM l"""

ORACLES["gated_turns"] = f"""WITH g AS (SELECT conv_id, turn, {gate_message('text')} AS message FROM conversations)
SELECT conv_id, turn, {accepted('message')} AS is_product_feedback,
       CASE WHEN {accepted('message')} THEN '{ACCEPTED}' ELSE '{REJECTED}' END AS domain_status, message FROM g"""


def _swap(pattern, by):
    # Twice: a spelled boundary uses up the space between two hits in a row.
    once = replace("text", rf"(^|[^a-zA-Z0-9_])(?:{pattern})($|[^a-zA-Z0-9_])", rf"\1{by}\2")
    return once.replace("regexp_replace(text", f"regexp_replace({once}")


ORACLES["gated_documents"] = f"""WITH s AS (
  SELECT doc_id, 'text' AS part, CASE doc_id % 4 WHEN 0 THEN {_swap('on|la|der', 'quality')} WHEN 1 THEN {_swap('the|le|die', 'fever')}
         ELSE text END AS swapped FROM documents
  UNION ALL SELECT doc_id, 'lang', lang FROM documents),
g AS (SELECT doc_id, part, {gate_message('swapped')} AS message FROM s)
SELECT doc_id, part, {accepted('message')} AS is_product_feedback, message FROM g"""

ORACLES["join_keys"] = f"""SELECT concat('b', item_id) AS item, lower({strip('text')}) AS join_text FROM benchmark
UNION ALL SELECT concat('d', doc_id), md5(lower({strip('text')})) FROM documents"""

ORACLES["table_shape"] = f"WITH {reviews()} SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns FROM reviews"

_TYPES = {
    "review_id": "bigint", "product_id": "string", "reviewer_id": "string", "stars": "int", "review_body": "string",
    "review_title": "string", "language": "string", "product_category": "string",
}


def _profile(columns, select):
    return f"WITH {reviews()} " + " UNION ALL ".join(select(c) for c in columns)


def _blanks(c, expression=None):
    return f"count(*) FILTER ({strip(expression or c)} = '')" if _TYPES[c] == "string" else "CAST(NULL AS BIGINT)"


ORACLES["column_profile"] = _profile(
    _TYPES,
    lambda c: f"SELECT '{c}' AS column_name, '{_TYPES[c]}' AS data_type, count(*) FILTER ({c} IS NULL) AS n_null, "
    f"{_blanks(c)} AS n_blank FROM reviews",
)
ORACLES["null_counts"] = _profile(
    _TYPES, lambda c: f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM reviews"
)
_TITLE = "CASE WHEN review_id % 5 = 0 THEN concat(' ', chr(10), ' ') ELSE review_title END"
ORACLES["blank_counts"] = _profile(
    [c for c in _TYPES if _TYPES[c] == "string"],
    lambda c: f"SELECT '{c}' AS column_name, {_blanks(c, _TITLE if c == 'review_title' else None)} AS n_blank FROM reviews",
)

ORACLES["invalid_star_count"] = f"""WITH {reviews()}, odd AS (SELECT {ODD_STARS} AS stars FROM reviews)
SELECT count(*) FILTER (stars IS NULL OR stars NOT BETWEEN 1 AND 5) AS n_invalid_stars FROM odd"""

ORACLES["language_counts"] = counts("language")
ORACLES["category_counts"] = counts("product_category")
ORACLES["star_counts"] = counts("stars")

ORACLES["sentiment_shares"] = f"""WITH {prepared()}
SELECT sentiment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM prepared GROUP BY sentiment"""

ORACLES["distinct_ids"] = f"""WITH {reviews()}
SELECT count(DISTINCT review_id) AS distinct_review_id, count(DISTINCT product_id) AS distinct_product_id,
       count(DISTINCT reviewer_id) AS distinct_reviewer_id FROM reviews"""

ORACLES["distinct_ids_approximate"] = f"""WITH {reviews()}
SELECT count(DISTINCT review_id) AS distinct_review_id, count(DISTINCT product_id) AS distinct_product_id,
       count(DISTINCT reviewer_id) AS distinct_reviewer_id, true AS distinct_review_id_close,
       true AS distinct_product_id_close, true AS distinct_reviewer_id_close FROM reviews"""

ORACLES["duplicate_complete_rows"] = f"""WITH {reviews()},
twice AS (SELECT * EXCLUDE (review_id) FROM reviews
  UNION ALL SELECT * EXCLUDE (review_id) FROM reviews WHERE product_id LIKE 'src1:%'),
g AS (SELECT count(*) AS n FROM twice GROUP BY ALL)
SELECT (SELECT count(*) FROM twice) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS n_duplicate_rows"""

ORACLES["duplicate_bodies"] = f"""WITH {reviews()}
SELECT count(*) - count(DISTINCT review_body) - CAST(count(*) > count(review_body) AS BIGINT) AS n_duplicates FROM reviews"""

ORACLES["duplicate_titles"] = f"""WITH {reviews()}
SELECT count(review_title) - count(DISTINCT review_title) AS n_duplicates FROM reviews"""


def _group_sizes(key, products):
    return f"""WITH {reviews(products)}, sizes AS (SELECT count(*) AS v FROM reviews WHERE {key} IS NOT NULL GROUP BY {key})
SELECT '{key}' AS key, count(*) AS n_groups, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
       round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75 FROM sizes"""


ORACLES["reviews_per_product"] = _group_sizes("product_id", 7)
ORACLES["reviews_per_reviewer"] = _group_sizes("reviewer_id", 97)

ORACLES["text_length_stats"] = f"""WITH {reviews()}, texts AS (
  SELECT 'review_body' AS c, coalesce(review_body, '') AS t FROM reviews
  UNION ALL SELECT 'review_title', coalesce(review_title, '') FROM reviews),
sizes AS (
  SELECT concat(c, '_chars') AS measure, length(t) AS v FROM texts
  UNION ALL SELECT concat(c, '_words'), len(regexp_extract_all(t, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+')) FROM texts)
SELECT measure, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(min(v) AS BIGINT) AS min,
       CAST(max(v) AS BIGINT) AS max, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.75), 6) AS q75 FROM sizes GROUP BY measure"""

ORACLES["category_by_sentiment"] = f"""WITH {prepared()}
SELECT product_category, {', '.join(f"count(*) FILTER (sentiment = '{c}') AS \"{c}\"" for c in LABELS + ('Invalid',))}
FROM prepared GROUP BY product_category"""

ORACLES["category_by_stars"] = f"""WITH {reviews()}
SELECT product_category, {', '.join(f"count(*) FILTER (stars = {s}) AS stars_{s}" for s in range(1, 6))}
FROM reviews GROUP BY product_category"""

_STATS = ("mean", "std", "min", "max", "median", "q25", "q75")


def _stat_lines(section, key, sql):
    columns = ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in _STATS)
    return (
        f"SELECT '{section}' AS section, concat({key}, '.', s) AS key, printf('%.6f', v) AS value "
        f"FROM (UNPIVOT (SELECT {key}, {columns} FROM ({sql})) ON {', '.join(_STATS)} INTO NAME s VALUE v)"
    )


def _count_lines(section, key):
    return (
        f"SELECT '{section}', CAST({key} AS VARCHAR), CAST(count(*) AS VARCHAR) FROM prepared WHERE {key} IS NOT NULL GROUP BY ALL"
    )


_ID_LINES = " UNION ALL ".join(f"({_group_sizes(k, 97)})" for k in ("review_id", "product_id", "reviewer_id"))
_BLANK = {c: f"count(*) FILTER ({strip(c)} = '')" for c, t in _TYPES.items() if t == "string"}
ORACLES["audit_entries"] = f"WITH {prepared()} " + " UNION ALL ".join(
    [
        _stat_lines("text_lengths", "measure", ORACLES["text_length_stats"]),
        _stat_lines("reviews_per_id", "key", _ID_LINES),
        f"SELECT 'distinct_ids', key, CAST(n_groups AS VARCHAR) FROM ({_ID_LINES})",
        "SELECT 'shape', 'n_rows', CAST(count(*) AS VARCHAR) FROM reviews",
        "SELECT 'shape', 'n_columns', '8'",
        *[f"SELECT 'column_types', '{c}', '{t}'" for c, t in _TYPES.items()],
        *[f"SELECT 'missing_values', '{c}', CAST(count(*) FILTER ({c} IS NULL) AS VARCHAR) FROM reviews" for c in _TYPES],
        *[f"SELECT 'empty_strings', '{c}', CAST({n} AS VARCHAR) FROM reviews" for c, n in _BLANK.items()],
        "SELECT 'invalid_stars', 'invalid_stars', CAST(count(*) FILTER (stars IS NULL OR stars NOT BETWEEN 1 AND 5) AS VARCHAR) FROM reviews",
        f"SELECT 'duplicates', 'review_bodies', CAST(n_duplicates AS VARCHAR) FROM ({ORACLES['duplicate_bodies']})",
        f"SELECT 'duplicates', 'review_titles', CAST(n_duplicates AS VARCHAR) FROM ({ORACLES['duplicate_titles']})",
        "SELECT 'duplicates', 'complete_rows', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM reviews)) AS VARCHAR) FROM reviews",
        _count_lines("language_distribution", "language"),
        _count_lines("category_distribution", "product_category"),
        _count_lines("star_distribution", "stars"),
        _count_lines("sentiment_distribution", "sentiment"),
        _count_lines("category_by_sentiment", "concat(product_category, '.', sentiment)"),
        _count_lines("category_by_stars", "concat(product_category, '.', stars)"),
        "SELECT 'sentiment_percent', sentiment, printf('%.6f', count(*) * 100.0 / sum(count(*)) OVER ()) FROM prepared GROUP BY sentiment",
    ]
)

_GROUPS = f"""{prepared()}, groups AS (
  SELECT sha256(review_body) AS body_sha256, count(*) AS n_rows, count(DISTINCT sentiment) AS n_sentiments,
         count(DISTINCT product_id) AS n_products
  FROM prepared GROUP BY review_body HAVING count(*) > 1)"""

ORACLES["duplicate_groups"] = f"""WITH {_GROUPS}
SELECT *, n_sentiments = 1 AS is_a, n_sentiments > 1 AS is_b, n_products > 1 AS is_c FROM groups"""

ORACLES["duplicate_summary"] = f"WITH {_GROUPS} " + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, CAST(coalesce(sum(n_rows), 0) AS BIGINT) AS n_rows, count(*) AS n_texts FROM groups WHERE {test}"
    for kind, test in {"A": "n_sentiments = 1", "B": "n_sentiments > 1", "C": "n_products > 1"}.items()
)

_IDS = "review_id, product_id, stars, sentiment, md5(review_body) AS body_md5"

ORACLES["without_conflicts"] = f"""WITH {prepared()}
SELECT {_IDS} FROM prepared WHERE review_body NOT IN (
  SELECT review_body FROM prepared GROUP BY review_body HAVING count(DISTINCT sentiment) > 1)"""

ORACLES["first_per_body"] = f"""WITH {prepared()}
SELECT {_IDS} FROM prepared QUALIFY row_number() OVER (PARTITION BY review_body ORDER BY review_id) = 1"""

ORACLES["without_empty_bodies"] = f"""WITH {prepared()},
changed AS (SELECT * REPLACE (CASE WHEN review_id % 10 = 3 THEN concat(' ', chr(10), ' ') ELSE review_body END AS review_body) FROM prepared)
SELECT {_IDS} FROM changed WHERE {strip('review_body')} <> ''"""

ORACLES["clean_reviews"] = f"""WITH {CLEANED}
SELECT * REPLACE (md5(review_body) AS review_body, md5(review_title) AS review_title) FROM cleaned"""
ORACLES["clean_reviews_staged"] = f"WITH {CLEANED} SELECT {_IDS} FROM cleaned"

ORACLES["cleaning_report"] = f"""WITH {CLEANED}, n AS (
  SELECT (SELECT count(*) FROM prepared) AS initial, (SELECT count(*) FROM prepared WHERE {strip('review_body')} = '') AS empty,
         (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM groups WHERE n_labels > 1 AND {strip('review_body')} <> '') AS conflicting,
         (SELECT count(*) FROM cleaned) AS final)
SELECT 'initial_rows' AS metric, CAST(NULL AS VARCHAR) AS label, initial AS n, CAST(NULL AS DOUBLE) AS percent FROM n
UNION ALL SELECT 'filled_titles', NULL, (SELECT count(*) FROM documents WHERE doc_id % 61 = 0), NULL FROM n
UNION ALL SELECT 'rows_in_duplicate_groups', NULL, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM groups WHERE n > 1 AND {strip('review_body')} <> ''), NULL FROM n
UNION ALL SELECT 'duplicate_texts', NULL, (SELECT count(*) FROM groups WHERE n > 1 AND {strip('review_body')} <> ''), NULL FROM n
UNION ALL SELECT 'dropped_empty_body', NULL, empty, NULL FROM n
UNION ALL SELECT 'dropped_conflicting', NULL, conflicting, NULL FROM n
UNION ALL SELECT 'dropped_repeated', NULL, initial - empty - conflicting - final, NULL FROM n
UNION ALL SELECT 'dropped_total', NULL, initial - final, NULL FROM n
UNION ALL SELECT 'final_rows', NULL, final, NULL FROM n
""" + "\n".join(
    f"UNION ALL SELECT 'final_class', '{c}', k, CASE WHEN final > 0 THEN round(k * 100.0 / final, 6) END "
    f"FROM n, (SELECT count(*) AS k FROM cleaned WHERE sentiment = '{c}')"
    for c in LABELS + ("Invalid",)
)


def _ranked_groups(seeds, source="prepared"):
    return f"""seeds AS (SELECT CAST(unnest(range({seeds[0]}, {seeds[1]})) AS INTEGER) AS seed),
places AS (
  SELECT seed, product_id, count(*) OVER (PARTITION BY seed) AS g,
         row_number() OVER (PARTITION BY seed ORDER BY md5(concat(product_id, ':', CAST(seed AS VARCHAR))), product_id) AS place
  FROM (SELECT DISTINCT product_id FROM {source}), seeds),
quotas AS (SELECT *, floor(CAST(0.7 AS DOUBLE) * g) AS n_train FROM places),
split_of AS (
  SELECT seed, product_id, CASE WHEN place <= n_train THEN 'train'
         WHEN place <= n_train + floor(CAST(0.5 AS DOUBLE) * (g - n_train)) THEN 'val' ELSE 'test' END AS split FROM quotas)"""


_SPLIT = f"""{prepared(7)}, {_ranked_groups((42, 43))},
splits AS (SELECT p.*, s.split FROM prepared p JOIN split_of s ON p.product_id = s.product_id)"""

ORACLES["group_split"] = f"WITH {_SPLIT} SELECT review_id, product_id, split FROM splits"

_SCORES = f"""{prepared(7)}, {_ranked_groups((42, 142))},
sizes AS (SELECT seed, split, sentiment, count(*) AS n FROM prepared p JOIN split_of s ON p.product_id = s.product_id GROUP BY ALL),
grid AS (SELECT seed, split, sentiment FROM seeds, (SELECT unnest(['train', 'val', 'test']) AS split),
         (SELECT unnest(['Negative', 'Neutral', 'Positive']) AS sentiment)),
filled AS (SELECT g.*, coalesce(s.n, 0) AS n FROM grid g LEFT JOIN sizes s USING (seed, split, sentiment)),
gaps AS (
  SELECT seed, abs(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY seed, split)
         - CAST(sum(n) OVER (PARTITION BY seed, sentiment) AS DOUBLE) / sum(n) OVER (PARTITION BY seed)) AS gap FROM filled),
scores AS (SELECT seed, sum(gap) AS divergence FROM gaps GROUP BY seed)"""

ORACLES["seed_divergence"] = f"WITH {_SCORES} SELECT seed, round(divergence, 6) AS divergence FROM scores"

ORACLES["best_group_split"] = f"""WITH {_SCORES}, best AS (SELECT * FROM scores ORDER BY round(divergence, 12), seed LIMIT 1)
SELECT p.review_id, s.split, b.seed, round(b.divergence, 6) AS divergence
FROM prepared p JOIN split_of s ON p.product_id = s.product_id JOIN best b ON s.seed = b.seed"""

_BY_REVIEW = """row_places AS (
  SELECT product_id, review_id, count(*) OVER () AS g, row_number() OVER (ORDER BY md5(concat(CAST(review_id AS VARCHAR), ':42'))) AS place
  FROM prepared),
row_splits AS (
  SELECT product_id, CASE WHEN place <= floor(CAST(0.7 AS DOUBLE) * g) THEN 'train'
         WHEN place <= floor(CAST(0.7 AS DOUBLE) * g) + floor(CAST(0.5 AS DOUBLE) * (g - floor(CAST(0.7 AS DOUBLE) * g))) THEN 'val'
         ELSE 'test' END AS split FROM row_places)"""


def _leak(table, kind):
    flags = ", ".join(f"bool_or(split = '{s}') AS {s}" for s in ("train", "val", "test"))
    return (
        "SELECT count(*) FILTER (train AND val) AS train_val, count(*) FILTER (train AND test) AS train_test, "
        f"count(*) FILTER (val AND test) AS val_test, '{kind}' AS kind "
        f"FROM (SELECT product_id, {flags} FROM {table} GROUP BY product_id)"
    )


ORACLES["split_leakage"] = (
    f"WITH {_SPLIT}, {_BY_REVIEW} {_leak('splits', 'by product')} UNION ALL {_leak('row_splits', 'by review')}"
)

_CLASS_COUNTS = ", ".join(f"count(*) FILTER (sentiment = '{c}') AS \"n_{c}\"" for c in LABELS)
_CLASS_SHARES = ", ".join(f"round(\"n_{c}\" * 100.0 / n_rows, 6) AS \"percent_{c}\"" for c in LABELS)
ORACLES["split_report"] = f"""WITH {_SPLIT}, r AS (
  SELECT split, count(*) AS n_rows, count(DISTINCT product_id) AS n_keys, {_CLASS_COUNTS} FROM splits GROUP BY split
  UNION ALL SELECT 'population', count(*), count(DISTINCT product_id), {_CLASS_COUNTS} FROM splits)
SELECT *, round(n_rows * 100.0 / (SELECT count(*) FROM splits), 6) AS percent_rows, {_CLASS_SHARES} FROM r"""

_HASH_ORDER = "ORDER BY md5(concat(CAST(review_id AS VARCHAR), ':42'))"
ORACLES["stratified_split"] = f"""WITH {prepared()}, c AS (SELECT sentiment, count(*) AS n FROM prepared GROUP BY sentiment),
t AS (SELECT *, (SELECT count(*) FROM prepared) AS total FROM c),
q AS (SELECT *, total - ceil(CAST(0.2 AS DOUBLE) * total) AS n_train FROM t),
s AS (SELECT *, CAST(n AS DOUBLE) * n_train / total AS share FROM q),
o AS (SELECT *, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, sentiment)
      <= n_train - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM s)
SELECT p.review_id, p.sentiment, CASE WHEN row_number() OVER (PARTITION BY p.sentiment {_HASH_ORDER}) <= o.quota
       THEN 'train' ELSE 'test' END AS split
FROM prepared p JOIN o ON p.sentiment = o.sentiment"""

ORACLES["stacked_splits"] = f"""WITH {prepared()}
SELECT CASE WHEN language = 'en' THEN 'en' ELSE 'other' END AS split, count(*) AS n, CAST(sum(stars) AS BIGINT) AS sum_stars
FROM prepared GROUP BY ALL"""

ORACLES["sample_per_class"] = f"""WITH {prepared()}
SELECT review_id, sentiment FROM prepared QUALIFY row_number() OVER (PARTITION BY sentiment {_HASH_ORDER}) <= 20"""

_TEXT_B = strip("concat(coalesce(review_title, ''), ' ', coalesce(review_body, ''))")


def _bigrams(x):
    return f"list_transform(range(1, len({x})), lambda i: concat({x}[i], ' ', {x}[i + 1]))"


def _terms(n_max, source="reviews", text=_TEXT_B, columns="review_id"):
    grams = "words" if n_max == 1 else f"list_concat(words, {_bigrams('words')})"
    return f"""word_lists AS (SELECT {columns}, {words(text)} AS words FROM {source}),
term_lists AS (SELECT {columns}, {grams} AS terms FROM word_lists)"""


def _vocabulary(min_df, max_features, source="term_lists"):
    return f"""occurrences AS (SELECT review_id, unnest(terms) AS term FROM {source}),
tf AS (SELECT review_id, term, count(*) AS tf FROM occurrences GROUP BY ALL),
vocabulary AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term HAVING count(*) >= {min_df}
  ORDER BY cf DESC, term LIMIT {max_features})"""


def _weights(tf="tf"):
    return f"""idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM term_lists)) / (1.0 + df)) + 1 AS idf FROM vocabulary),
raw AS (SELECT review_id, term, {tf} * idf AS w FROM tf JOIN idf USING (term)),
weights AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM raw)"""


for _name, _n in (("term_token_lists", 1), ("ngram_lists", 2)):
    ORACLES[_name] = f"""WITH {reviews()}, {_terms(_n)}
SELECT review_id, len(terms) AS n_terms, md5({joined('terms', ',')}) AS terms FROM term_lists"""

ORACLES["vocabulary"] = f"WITH {reviews()}, {_terms(2)}, {_vocabulary(2, 50000)} SELECT term, df, cf FROM vocabulary"

ORACLES["term_idf"] = f"""WITH {reviews()}, {_terms(1)}, {_vocabulary(2, 50000)}
SELECT term, df, cf, round(ln((1.0 + (SELECT count(*) FROM reviews)) / (1.0 + df)) + 1, 6) AS idf,
       row_number() OVER (ORDER BY term) - 1 AS term_index FROM vocabulary"""

ORACLES["tfidf_weights"] = f"""WITH {reviews()}, {_terms(1)}, {_vocabulary(2, 50000)}, {_weights()}
SELECT review_id, term, round(weight, 6) AS weight FROM weights"""

ORACLES["tfidf_weights_sublinear"] = f"""WITH {reviews()}, {_terms(2)}, {_vocabulary(1, 10000)}, {_weights('(1 + ln(tf))')}
SELECT review_id, term, round(weight, 6) AS weight FROM weights"""

ORACLES["features_of_unseen"] = f"""WITH {_SPLIT}, {_terms(1, 'splits', columns='review_id, split')},
fit AS (SELECT * FROM term_lists WHERE split = 'train'), {_vocabulary(2, 50000, 'fit')},
others AS (SELECT review_id, split, unnest(list_distinct(terms)) AS term FROM term_lists WHERE split <> 'train'),
known AS (SELECT review_id, count(*) AS k FROM others JOIN vocabulary USING (term) GROUP BY review_id)
SELECT t.review_id, t.split, coalesce(k, 0) AS num_nonzero_features, (SELECT count(*) FROM vocabulary) AS vocabulary_size
FROM term_lists t LEFT JOIN known USING (review_id) WHERE t.split <> 'train'"""

ORACLES["weights_of_unseen"] = f"""WITH {_SPLIT}, {_terms(1, 'splits', columns='review_id, split')},
fit AS (SELECT * FROM term_lists WHERE split = 'train'), {_vocabulary(2, 50000, 'fit')},
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM fit)) / (1.0 + df)) + 1 AS idf FROM vocabulary),
others AS (SELECT review_id, split, unnest(terms) AS term FROM term_lists WHERE split <> 'train'),
raw AS (SELECT review_id, split, term, count(*) * any_value(idf) AS w FROM others JOIN idf USING (term) GROUP BY ALL)
SELECT review_id, split, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY review_id)), 6) AS weight FROM raw"""

ORACLES["sublinear_vectors"] = f"""WITH {reviews()}, {_terms(1)}, {_vocabulary(1, 10000)}, {_weights('(1 + ln(tf))')},
numbered AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index FROM vocabulary)
SELECT review_id, term_index, round(weight, 6) AS weight FROM weights JOIN numbered USING (term)"""

ORACLES["class_weights"] = f"""WITH {LABELLED}, c AS (SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment)
SELECT sentiment, n, round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c"""

ORACLES["row_weights"] = f"""WITH {LABELLED}, c AS (SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment)
SELECT review_id, sentiment, round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 6) AS weight
FROM labelled JOIN c USING (sentiment)"""



def _bayes_rules(rows="labelled"):
    return f"""classes AS (SELECT unnest({list(LABELS)}) AS class),
sums AS (SELECT l.sentiment AS class, w.term, sum(w.weight) AS total FROM weights w JOIN {rows} l USING (review_id) GROUP BY ALL),
filled AS (SELECT c.class, v.term, coalesce(s.total, 0) + 1.0 AS total FROM classes c CROSS JOIN vocabulary v
  LEFT JOIN sums s ON s.class = c.class AND s.term = v.term),
log_probs AS (SELECT class, term, ln(total / sum(total) OVER (PARTITION BY class)) AS log_prob FROM filled),
priors AS (SELECT sentiment AS class, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {rows})) AS log_prior
  FROM {rows} GROUP BY sentiment)"""


_BAYES_RULES = _bayes_rules()
_BAYES = f"{LABELLED}, {_terms(1, 'labelled')}, {_vocabulary(2, 50000)}, {_weights()}, {_BAYES_RULES}"

ORACLES["naive_bayes_terms"] = f"WITH {_BAYES} SELECT class, term, round(log_prob, 6) AS log_prob FROM log_probs"
ORACLES["naive_bayes_priors"] = f"WITH {_BAYES} SELECT class, round(log_prior, 6) AS log_prior FROM priors"

_SCORE_COLUMNS = ", ".join(f"round(max(s) FILTER (class = '{c}'), 5) AS \"log_score_{c}\"" for c in LABELS)
ORACLES["naive_bayes_scores"] = f"""WITH {_BAYES},
sums_of AS (SELECT review_id, class, sum(weight * log_prob) AS s FROM weights JOIN log_probs USING (term) GROUP BY ALL),
scores AS (SELECT l.review_id, p.class, p.log_prior + coalesce(o.s, 0) AS s FROM labelled l CROSS JOIN priors p
  LEFT JOIN sums_of o ON o.review_id = l.review_id AND o.class = p.class)
SELECT review_id, arg_max(class, s) AS predicted_sentiment, {_SCORE_COLUMNS} FROM scores GROUP BY review_id"""


_PROCESSED = joined(lemmas(kept(tokens("review_body"))))
ORACLES["naive_bayes_vectors"] = f"""WITH {LABELLED},
processed AS (SELECT review_id, {_PROCESSED} AS text FROM labelled),
{_terms(2, 'processed', 'text')}, {_vocabulary(1, 10000)}, {_weights('(1 + ln(tf))')}, {_BAYES_RULES},
smoothed AS (SELECT sentiment AS class, ln((count(*) + 1.0) / ((SELECT count(*) FROM labelled) + 3.0)) AS log_prior
  FROM labelled GROUP BY sentiment),
sums_of AS (SELECT review_id, class, sum(weight * log_prob) AS s FROM weights JOIN log_probs USING (term) GROUP BY ALL),
scores AS (SELECT l.review_id, l.sentiment, p.class, p.log_prior + coalesce(o.s, 0) AS s FROM labelled l CROSS JOIN smoothed p
  LEFT JOIN sums_of o ON o.review_id = l.review_id AND o.class = p.class)
SELECT review_id, sentiment, arg_max(class, s) AS predicted_sentiment FROM scores GROUP BY ALL"""

_FIT = f"""{LABELLED},
stripped AS (SELECT * REPLACE ({strip("coalesce(review_title, '')")} AS review_title,
  {strip("coalesce(review_body, '')")} AS review_body) FROM labelled),
{_ranked_groups((42, 43), 'stripped')},
fit AS (SELECT p.* FROM stripped p JOIN split_of s ON p.product_id = s.product_id WHERE s.split <> 'test')"""
_ITEM_WORDS = f"""item_words AS (SELECT item_id, {words('text')} AS w FROM benchmark),
item_terms AS (SELECT DISTINCT item_id, unnest(list_concat(w, {_bigrams('w')})) AS term FROM item_words)"""
ORACLES["unknown_terms"] = f"""WITH {_FIT}, {_terms(2, 'fit')}, {_vocabulary(2, 50000)}, {_ITEM_WORDS}
SELECT item_id, term FROM item_terms WHERE term NOT IN (SELECT term FROM vocabulary)"""


def _model_scores(source, keys, text="text", processed=False):
    """CTEs up to ``probabilities`` (keys, class, p): the fitted naive Bayes model applied to ``source``."""
    fit_text, own = _TEXT_B, words(text)
    prepare = ""
    if processed:
        prepare = f"cooked AS (SELECT review_id, {joined(lemmas(kept(tokens(_TEXT_B))))} AS text FROM fit),\n"
        fit_text, own = "text", words(joined(lemmas(kept(tokens(text)))))
    rows = "cooked" if processed else "fit"
    return f"""{_FIT}, {prepare}{_terms(2, rows, fit_text)}, {_vocabulary(2, 50000)}, {_weights()}, {_bayes_rules('fit')},
smoothed AS (SELECT class, ln((count(sentiment) + 1.0) / ((SELECT count(*) FROM fit) + 3.0)) AS log_prior
  FROM classes LEFT JOIN fit ON sentiment = class GROUP BY class),
s_words AS (SELECT {keys}, {own} AS w FROM {source}),
s_terms AS (SELECT {keys}, unnest(list_concat(w, {_bigrams('w')})) AS term FROM s_words),
s_raw AS (SELECT {keys}, term, count(*) * any_value(idf) AS w FROM s_terms JOIN idf USING (term) GROUP BY ALL),
s_weights AS (SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS weight FROM s_raw),
s_sums AS (SELECT {keys}, class, sum(weight * log_prob) AS s FROM s_weights JOIN log_probs USING (term) GROUP BY ALL),
s_all AS (SELECT {keys}, class, log_prior FROM s_words CROSS JOIN smoothed),
s_scores AS (SELECT {keys}, class, log_prior + coalesce(s, 0) AS s FROM s_all LEFT JOIN s_sums USING ({keys}, class)),
s_top AS (SELECT *, max(s) OVER (PARTITION BY {keys}) AS top FROM s_scores),
probabilities AS (SELECT {keys}, class, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY {keys}) AS p FROM s_top),
answers AS (SELECT {keys}, arg_max(class, p) AS predicted_sentiment, round(max(p) * 100, 2) AS confidence,
  {', '.join(f"max(p) FILTER (class = '{c}') AS \"p_{c}\"" for c in LABELS)} FROM probabilities GROUP BY ALL),
s_features AS (SELECT {keys}, count(*) AS k FROM s_weights GROUP BY ALL)"""


_PROBABILITIES = ", ".join(f"round(\"p_{c}\", 6) AS \"prob_{c}\"" for c in LABELS)
ORACLES["scored_turns"] = f"""WITH {_model_scores('conversations', 'conv_id, turn')}
SELECT c.*, predicted_sentiment, confidence, {_PROBABILITIES} FROM conversations c JOIN answers USING (conv_id, turn)"""

ORACLES["scored_turns_processed"] = f"""WITH {_model_scores('conversations', 'conv_id, turn', processed=True)}
SELECT c.*, predicted_sentiment, confidence, {joined(lemmas(kept(tokens('c.text'))))} AS processed_text
FROM conversations c JOIN answers USING (conv_id, turn)"""

ORACLES["saved_pipeline_scores"] = f"""WITH {_model_scores('benchmark', 'item_id')}
SELECT b.*, predicted_sentiment, confidence FROM benchmark b JOIN answers USING (item_id)"""

ORACLES["probability_columns"] = f"""WITH {_model_scores('benchmark', 'item_id')}
SELECT item_id, {_PROBABILITIES} FROM answers"""

ORACLES["feature_contributions"] = f"""WITH {_model_scores('benchmark', 'item_id')},
wide AS (SELECT term, {', '.join(f"max(log_prob) FILTER (class = '{c}') AS \"w_{c}\"" for c in LABELS)} FROM log_probs GROUP BY term)
SELECT item_id, term, round(weight, 6) AS tfidf, {', '.join(f"round(\"w_{c}\", 6) AS \"weight_{c}\"" for c in LABELS)},
  {', '.join(f"round(weight * \"w_{c}\", 6) AS \"contribution_{c}\"" for c in LABELS)} FROM s_weights JOIN wide USING (term)"""

ORACLES["solver_gradients"] = f"""WITH {LABELLED},
stripped AS (SELECT * REPLACE ({strip("coalesce(review_title, '')")} AS review_title,
  {strip("coalesce(review_body, '')")} AS review_body) FROM labelled),
{_ranked_groups((42, 43), 'stripped')},
fit AS (SELECT p.* FROM stripped p JOIN split_of s ON p.product_id = s.product_id WHERE s.split = 'train')
SELECT class, count(sentiment) AS n_rows, true AS at_minimum
FROM (SELECT unnest({list(LABELS)}) AS class) LEFT JOIN fit ON sentiment = class GROUP BY class"""


def _metrics(source, by=None, actual="sentiment", always=False):
    """CTEs ``label_rows`` and ``averages`` of a scored table, per group."""
    keys = f"{by}, " if by else ""
    join = f"USING ({keys}label)"
    listed = (
        f"SELECT {keys}{actual} AS label FROM {source} UNION SELECT {keys}predicted_sentiment FROM {source}"
        + (f" UNION SELECT unnest({list(LABELS)})" if always else "")
    )
    group = f"GROUP BY {by}" if by else ""
    return f"""listed AS ({listed}),
support AS (SELECT {keys}{actual} AS label, count(*) AS support FROM {source} GROUP BY ALL),
predicted AS (SELECT {keys}predicted_sentiment AS label, count(*) AS predicted FROM {source} GROUP BY ALL),
hits AS (SELECT {keys}{actual} AS label, count(*) AS hits FROM {source} WHERE {actual} = predicted_sentiment GROUP BY ALL),
joined AS (SELECT {keys}label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
  FROM listed LEFT JOIN support {join} LEFT JOIN predicted {join} LEFT JOIN hits {join}),
rates AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall FROM joined),
label_rows AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates),
averages AS (SELECT {keys}CAST(sum(support) AS BIGINT) AS n, CAST(sum(hits) AS DOUBLE) / sum(support) AS accuracy,
  avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
  sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
  sum(f1 * support) / sum(support) AS weighted_f1 FROM label_rows WHERE support + predicted > 0 {group})"""


_M = f"{SCORED}, {_metrics('scored', always=True)}"
_AVERAGES = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")

ORACLES["confusion_matrix"] = f"""WITH {SCORED}
SELECT actual, {', '.join(f"count(*) FILTER (sentiment = actual AND predicted_sentiment = '{p}') AS \"predicted_{p}\"" for p in LABELS)}
FROM (SELECT unnest({list(LABELS)}) AS actual) LEFT JOIN scored ON scored.sentiment = actual GROUP BY actual"""

ORACLES["class_metrics"] = f"""WITH {_M}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM label_rows
WHERE label IN ('Negative', 'Neutral', 'Positive')"""

ORACLES["overall_metrics"] = f"WITH {_M} SELECT n, {', '.join(f'round({m}, 6) AS {m}' for m in _AVERAGES)} FROM averages"


def _report(m):
    return f"""WITH {m}
SELECT label AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM label_rows
WHERE label IN ('Negative', 'Neutral', 'Positive')
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), n FROM averages
UNION ALL SELECT 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), n FROM averages
UNION ALL SELECT 'weighted avg', round(weighted_precision, 6), round(weighted_recall, 6), round(weighted_f1, 6), n FROM averages"""


ORACLES["classification_report"] = _report(_M)

_F1 = ", ".join(f"round(coalesce(max(f1) FILTER (label = '{c}'), 0), 6) AS \"f1_{c}\"" for c in LABELS)
ORACLES["domain_metrics"] = f"""WITH {SCORED}, {_metrics('scored', 'product_category')},
f1s AS (SELECT product_category, {_F1} FROM label_rows GROUP BY product_category)
SELECT product_category, n, round(accuracy, 6) AS accuracy, f1s.* EXCLUDE (product_category), round(macro_f1, 6) AS macro_f1,
       n < 100 AS unstable FROM averages JOIN f1s USING (product_category)"""

_NEW = " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, {m} AS value FROM averages" for m in LEGACY_BASELINE if not m.startswith("f1_")]
    + ["SELECT concat('f1_', label), f1 FROM label_rows WHERE label <> 'Invalid'"]
)
_OLD = ", ".join(f"('{m}', CAST({v} AS DOUBLE))" for m, v in LEGACY_BASELINE.items())
ORACLES["baseline_comparison"] = f"""WITH {_M}, new AS ({_NEW}), old(metric, baseline) AS (VALUES {_OLD})
SELECT metric, round(baseline, 6) AS baseline, round(value, 6) AS value, round(value - baseline, 6) AS delta FROM new JOIN old USING (metric)"""

_TRIALS = ", ".join(f"({no}, {quoted(x)})" for no, x in enumerate(("en", "fr", "de", "es", "none"), 1))
ORACLES["best_of_results"] = f"""WITH {SCORED}, trials(exp_no, wrong) AS (VALUES {_TRIALS}),
guesses AS (SELECT exp_no, sentiment, CASE WHEN language = wrong THEN 'Neutral' ELSE predicted_sentiment END AS predicted_sentiment
  FROM scored, trials), {_metrics('guesses', 'exp_no')}
SELECT exp_no, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM averages ORDER BY averages.macro_f1 DESC, exp_no LIMIT 1"""

ORACLES["parity_check"] = f"""WITH {SCORED}, base AS (
  SELECT review_id, language, predicted_sentiment AS label_a,
         CASE WHEN review_id % 23 = 0 THEN 'Neutral' ELSE predicted_sentiment END AS label_b,
         CASE WHEN review_id % 7 = 0 THEN 0.01 ELSE 0.0 END AS gap FROM scored)
SELECT review_id, CASE WHEN language <> 'es' THEN label_a END AS label_a, CASE WHEN language <> 'de' THEN label_b END AS label_b,
       CASE WHEN language NOT IN ('es', 'de') THEN CAST(gap AS DOUBLE) END AS max_probability_gap,
       CASE language WHEN 'es' THEN 'a' WHEN 'de' THEN 'b' END AS missing_in,
       language NOT IN ('es', 'de') AND label_a = label_b AND gap = 0 AND review_id % 31 <> 0 AS match FROM base"""

_KEY = f"lower({strip('text')})"
ORACLES["text_overlap"] = f"""WITH {reviews()}, items AS (
  SELECT concat(conv_id, '-', turn) AS item, text FROM conversations
  UNION ALL SELECT concat('b', item_id), text FROM benchmark
  UNION ALL SELECT concat('r', review_id), concat(' ', coalesce(review_title, ''), chr(10)) FROM reviews),
seen AS (SELECT lower({strip("coalesce(review_body, '')")}) AS k FROM reviews
  UNION SELECT lower({strip("coalesce(review_title, '')")}) FROM reviews)
SELECT item, text FROM items WHERE {_KEY} IN (SELECT k FROM seen)"""

_UNSEEN = f"{SCORED}, unseen AS (SELECT language AS domain, sentiment, predicted_sentiment FROM scored WHERE review_id % 29 <> 0)"
ORACLES["unseen_benchmark"] = f"""WITH {_UNSEEN}, doubled AS (
  SELECT * FROM unseen UNION ALL SELECT 'all', sentiment, predicted_sentiment FROM unseen), {_metrics('doubled', 'domain')}
SELECT domain, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM averages"""

ORACLES["sentiment_distribution"] = f"WITH {LABELLED} SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment"

ORACLES["category_accuracy"] = f"""WITH {SCORED}
SELECT product_category, count(*) AS n, count(*) FILTER (sentiment = predicted_sentiment) AS n_correct,
       round(avg(CAST(sentiment = predicted_sentiment AS DOUBLE)), 6) AS accuracy FROM scored GROUP BY product_category"""

_KEYWORD_LIST = "[" + ", ".join(quoted(w) for w in KEYWORDS) + "]"
ORACLES["keyword_classes"] = f"""WITH {prepared()},
hits AS (SELECT sentiment, unnest(list_distinct({words('review_body')})) AS word FROM prepared)
SELECT k.word, count(h.word) AS n_total, {', '.join(f"count(*) FILTER (h.sentiment = '{c}') AS \"n_{c}\"" for c in LABELS)}
FROM (SELECT unnest({_KEYWORD_LIST}) AS word) k LEFT JOIN hits h ON h.word = k.word GROUP BY k.word"""

ORACLES["gate_decisions"] = f"""WITH g AS (SELECT conv_id, turn, {gate_message('text')} AS message, {clean('text')} AS cleaned_text FROM conversations)
SELECT conv_id, turn, {accepted('message')} AS is_valid_domain,
       CASE WHEN {accepted('message')} THEN '{ACCEPTED}' ELSE '{REJECTED}' END AS domain_status,
       message AS domain_message, cleaned_text FROM g"""

_GATED = f"""WITH {_model_scores('conversations', 'conv_id, turn')},
g AS (SELECT *, {gate_message('text')} AS message, {clean('text')} AS cleaned, {joined(lemmas(kept(tokens('text'))))} AS processed,
      {strip("coalesce(text, '')")} = '' AS blank, len({tokens('text')}) AS n_tokens FROM conversations)
SELECT conv_id, turn, {accepted('message')} AS is_valid_domain,
       CASE WHEN {accepted('message')} THEN '{ACCEPTED}' ELSE '{REJECTED}' END AS domain_status, message AS domain_message,
       CASE WHEN blank THEN 'Neutral' WHEN {accepted('message')} THEN predicted_sentiment END AS sentiment,
       CASE WHEN {accepted('message')} THEN confidence ELSE 0.0 END AS confidence,
       CASE WHEN {accepted('message')} THEN confidence ELSE 0.0 END AS predicted_class_probability,
       {', '.join(f"CASE WHEN blank THEN {v} WHEN {accepted('message')} THEN round(\"p_{c}\" * 100, 2) ELSE 0.0 END::DOUBLE AS \"percent_{c}\"" for c, v in zip(LABELS, (33.33, 33.34, 33.33)))},
       CASE WHEN {accepted('message')} AND processed <> '' THEN processed ELSE cleaned END AS cleaned_text,
       CASE WHEN NOT blank THEN processed END AS processed_text, CASE WHEN NOT blank THEN n_tokens END AS num_tokens,
       CASE WHEN NOT blank THEN coalesce(k, 0) END AS num_nonzero_features,
       CASE WHEN NOT blank THEN (SELECT count(*) FROM vocabulary) END AS vocabulary_size,
       CASE WHEN NOT blank THEN 'TF-IDF + NaiveBayes' END AS model_used
FROM g JOIN answers USING (conv_id, turn) LEFT JOIN s_features USING (conv_id, turn)"""
ORACLES["gated_scores"] = ORACLES["streamed_scores"] = ORACLES["streaming_scoring_job"] = _GATED

ORACLES["batch_scoring_job"] = f"""WITH turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, CASE WHEN text = '' THEN '.' ELSE text END AS text
  FROM conversations), {_model_scores('turns', 'conv_id, turn')}
SELECT predicted_sentiment, count(*) AS n, round(sum(confidence), 4) AS sum_confidence,
       (SELECT count(*) FROM answers) AS total_reviews,
       (SELECT count(*) FROM answers WHERE predicted_sentiment = 'Positive') AS positive_count,
       (SELECT count(*) FROM answers WHERE predicted_sentiment = 'Negative') AS negative_count,
       (SELECT count(*) FROM answers WHERE predicted_sentiment = 'Neutral') AS neutral_count,
       'text' AS detected_text_column, least(50, (SELECT count(*) FROM answers)) AS n_sample
FROM answers GROUP BY predicted_sentiment"""

_NOTEBOOK = f"""{LABELLED}, processed AS (SELECT review_id, sentiment, {_PROCESSED} AS text FROM labelled),
c AS (SELECT sentiment, count(*) AS n FROM processed GROUP BY sentiment),
t AS (SELECT *, (SELECT count(*) FROM processed) AS total FROM c),
q AS (SELECT *, total - ceil(CAST(0.2 AS DOUBLE) * total) AS n_train FROM t),
h AS (SELECT *, CAST(n AS DOUBLE) * n_train / total AS share FROM q),
o AS (SELECT *, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, sentiment)
      <= n_train - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM h),
placed AS (SELECT p.*, row_number() OVER (PARTITION BY p.sentiment {_HASH_ORDER}) <= o.quota AS train
  FROM processed p JOIN o ON p.sentiment = o.sentiment),
fit AS (SELECT * FROM placed WHERE train), held AS (SELECT * FROM placed WHERE NOT train),
{_terms(2, 'fit', 'text')}, {_vocabulary(1, 10000)}, {_weights('(1 + ln(tf))')}, {_bayes_rules('fit')},
smoothed AS (SELECT sentiment AS class, ln((count(*) + 1.0) / ((SELECT count(*) FROM fit) + 3.0)) AS log_prior
  FROM fit GROUP BY sentiment),
h_words AS (SELECT review_id, {words('text')} AS w FROM held),
h_terms AS (SELECT review_id, unnest(list_concat(w, {_bigrams('w')})) AS term FROM h_words),
h_raw AS (SELECT review_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM h_terms JOIN idf USING (term) GROUP BY ALL),
h_weights AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM h_raw),
sums_of AS (SELECT review_id, class, sum(weight * log_prob) AS s FROM h_weights JOIN log_probs USING (term) GROUP BY ALL),
scores AS (SELECT l.review_id, l.sentiment, p.class, p.log_prior + coalesce(o.s, 0) AS s FROM held l CROSS JOIN smoothed p
  LEFT JOIN sums_of o ON o.review_id = l.review_id AND o.class = p.class),
judged AS (SELECT review_id, sentiment, arg_max(class, s) AS predicted_sentiment FROM scores GROUP BY ALL)"""

_N = ", ".join(f"count(*) FILTER (predicted_sentiment = '{c}') AS {c.lower()}_count" for c in LABELS)
ORACLES["score_summary"] = f"WITH {SCORED} SELECT count(*) AS total_reviews, {_N}, 'review_body' AS detected_text_column FROM scored"

ORACLES["score_sample"] = f"WITH {SCORED} SELECT review_body, predicted_sentiment, CAST(confidence AS DOUBLE) AS confidence FROM scored ORDER BY review_id LIMIT 50"


def _word_counts(label):
    return f"""{SCORED}, t AS (SELECT {label} AS label, {tokens('review_body')} AS tokens FROM scored),
w AS (SELECT label, unnest({lemmas(kept('tokens'))}) AS word FROM t),
c AS (SELECT label, word, count(*) AS n FROM w GROUP BY ALL)"""


ORACLES["top_words_positive"] = f"""WITH {_word_counts('predicted_sentiment')}
SELECT word, n FROM c WHERE label = 'Positive' ORDER BY n DESC, word LIMIT 10"""

ORACLES["top_words_per_label"] = f"""WITH {_word_counts('sentiment')},
r AS (SELECT label, word, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10"""


ORACLES["notebook_comparison"] = _report(f"{_NOTEBOOK}, {_metrics('judged', always=True)}")


# Parts, batches and streams: the SQL has the whole tables at once.

_MERGED = ORACLES["text_length_stats"].rsplit("SELECT measure", 1)[0]
ORACLES["merged_length_stats"] = f"""{_MERGED} SELECT measure, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  CAST(min(v) AS BIGINT) AS min, CAST(max(v) AS BIGINT) AS max, true AS median_close, true AS q25_close, true AS q75_close
FROM sizes GROUP BY measure"""

ORACLES["merged_distinct_ids"] = ORACLES["distinct_ids_approximate"]

# A uniform number passes an edge of the Poisson distribution of mean 1 for every draw.
_EDGES = """edges AS (SELECT CAST(round(4294967296 * sum(p) OVER (ORDER BY k)) AS BIGINT) AS edge
  FROM (SELECT k, exp(-1) / factorial(CAST(k AS INTEGER)) AS p FROM range(11) t(k)))"""
_DRAWN = f"""{SCORED}, {_EDGES}, edge_list AS (SELECT list(edge) AS es FROM edges), numbered AS (
  SELECT product_category AS category, sentiment, predicted_sentiment, r,
         md5(concat(CAST(review_id AS VARCHAR), ':', CAST(r // 4 AS VARCHAR)))[r % 4 * 8 + 1 : r % 4 * 8 + 8] AS digits
  FROM scored, range(100) t(r)),
drawn AS (
  SELECT concat(category, '|', CAST(r AS VARCHAR)) AS replicate, sentiment, predicted_sentiment,
         unnest(range(len(list_filter(es, lambda e: CAST(concat('0x', digits) AS BIGINT) >= e)))) AS draw
  FROM numbered, edge_list)"""
_SPREAD = ", ".join(
    f"round(quantile_cont({m}, {share}), 6) AS {m}_{end}, quantile_cont({m}, {share}) AS {m}_{end}_exact"
    for m in ("accuracy", "macro_f1")
    for end, share in (("low", 0.025), ("high", 0.975))
)
ORACLES["domain_intervals"] = f"""WITH replicas AS (
  WITH {_DRAWN}, {_metrics('drawn', 'replicate')} SELECT split_part(replicate, '|', 1) AS product_category, accuracy, macro_f1 FROM averages),
spread AS (SELECT product_category, {_SPREAD} FROM replicas GROUP BY product_category),
point AS (WITH {SCORED}, {_metrics('scored', 'product_category')} SELECT product_category, n, accuracy, macro_f1 FROM averages)
SELECT product_category, n, round(accuracy, 6) AS accuracy, accuracy_low, accuracy_high, round(macro_f1, 6) AS macro_f1, macro_f1_low,
       macro_f1_high, accuracy_high_exact - accuracy_low_exact > 0.1 OR macro_f1_high_exact - macro_f1_low_exact > 0.1 AS unstable
FROM point JOIN spread USING (product_category)"""

ORACLES["parity_mismatches"] = f"SELECT * FROM ({ORACLES['parity_check']}) WHERE NOT match"


def _grams(w, n_max):
    runs = [w] + [
        f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i : i + {n - 1}], ' '))" for n in range(2, n_max + 1)
    ]
    return f"list_concat({runs[0]}, list_concat({runs[1]}, {runs[2]}))"


ORACLES["keyword_table_classes"] = f"""WITH {prepared()},
item_words AS (SELECT {words('text')} AS w FROM benchmark),
keywords AS (SELECT DISTINCT unnest({_grams('w', 3)}) AS word FROM item_words),
body_words AS (SELECT sentiment, {words('review_body')} AS w FROM prepared),
hits AS (SELECT sentiment, unnest(list_distinct({_grams('w', 3)})) AS word FROM body_words)
SELECT k.word, count(h.word) AS n_total, {', '.join(f"count(*) FILTER (h.sentiment = '{c}') AS {chr(34)}n_{c}{chr(34)}" for c in LABELS)}
FROM keywords k LEFT JOIN hits h ON h.word = k.word GROUP BY k.word"""

ORACLES["incremental_changes"] = f"""WITH {prepared()},
kept AS (SELECT k AS batch, review_body, min(review_id) AS review_id FROM prepared, range(5) t(k)
  WHERE stars <= k + 1 AND {strip('review_body')} <> '' GROUP BY k, review_body HAVING count(DISTINCT sentiment) = 1)
SELECT a.review_id, 'add' AS action, CAST(a.batch AS INTEGER) AS batch FROM kept a
WHERE NOT EXISTS (SELECT 1 FROM kept b WHERE b.batch = a.batch - 1 AND b.review_id = a.review_id)
UNION ALL
SELECT b.review_id, 'retract', CAST(b.batch + 1 AS INTEGER) FROM kept b
WHERE b.batch < 4 AND NOT EXISTS (SELECT 1 FROM kept a WHERE a.batch = b.batch + 1 AND a.review_id = b.review_id)"""

ORACLES["incremental_clean_ids"] = f"WITH {CLEANED} SELECT review_id FROM cleaned"

_TURNS = f"""turns AS (SELECT 1700000000 + conv_id * 420 + turn * 30 AS second, {star('(1 + (conv_id * 3 + turn) % 5)')} AS label, text
  FROM conversations)"""


def _window(seconds):
    start = f"second // {seconds} * {seconds}"
    return f"CAST({start} AS BIGINT) AS window_start, CAST({start} + {seconds} AS BIGINT) AS window_end"


ORACLES["windowed_summary"] = f"""WITH {_TURNS}, placed AS (SELECT {_window(21600)}, label AS predicted_sentiment FROM turns)
SELECT window_start, window_end, count(*) AS total_reviews, {_N} FROM placed GROUP BY ALL"""

ORACLES["windowed_top_words"] = f"""WITH {_TURNS},
t AS (SELECT {_window(172800)}, label, {tokens('text')} AS tokens FROM turns),
w AS (SELECT window_start, window_end, label, unnest({lemmas(kept('tokens'))}) AS word FROM t),
c AS (SELECT window_start, window_end, label, word, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start, label ORDER BY n DESC, word) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10"""


ORACLES["audit_document_entries"] = ORACLES["audit_entries"]


# Models that SQL cannot fit: what they are made of.

_STRIPPED = f"""{LABELLED},
stripped AS (SELECT * REPLACE ({strip("coalesce(review_title, '')")} AS review_title,
  {strip("coalesce(review_body, '')")} AS review_body) FROM labelled),
{_ranked_groups((42, 43), 'stripped')},
parts AS (SELECT p.*, s.split FROM stripped p JOIN split_of s ON p.product_id = s.product_id),
learned AS (SELECT * FROM parts WHERE split = 'train')"""


def _n_features(option, n_max, source="learned"):
    text = "review_body" if option == "A" else _TEXT_B
    return f"(WITH {_terms(n_max, source, text)}, {_vocabulary(2, 50000)} SELECT count(*) FROM vocabulary)"


_CONFIGS = [(1, "A", 1, "balanced"), (2, "A", 2, "balanced"), (3, "B", 1, "balanced"), (4, "B", 2, "balanced"), (5, "B", 2, "none")]
ORACLES["experiment_facts"] = f"WITH {_STRIPPED} " + " UNION ALL ".join(
    f"SELECT CAST({no} AS BIGINT) AS exp_no, '{option}' AS text_option, CAST({n_max} AS BIGINT) AS n_max, '{weight}' AS class_weight, "
    f"{_n_features(option, n_max)} AS n_features, (SELECT count(*) FROM learned) AS n_train, "
    "(SELECT count(*) FROM parts WHERE split = 'val') AS n_val, true AS converged"
    for no, option, n_max, weight in _CONFIGS
)

_SUPPORTS = ", ".join(f"count(*) FILTER (sentiment = '{c}') AS \"support_{c}\"" for c in LABELS)
ORACLES["final_model_facts"] = f"""WITH {_STRIPPED}, refit AS (SELECT * FROM parts WHERE split <> 'test'),
facts AS (SELECT {_n_features('B', 2, 'refit')} AS size)
SELECT 'B' AS text_option, CAST(2 AS INTEGER) AS n_max, 'balanced' AS class_weight, 'raw' AS text_mode,
       CAST(any_value(size) AS INTEGER) AS vocabulary_size, CAST(0 AS INTEGER) AS untrainable_rows, true AS converged,
       {_SUPPORTS}, count(*) AS n_predicted FROM parts, facts WHERE split = 'test'"""

ORACLES["vocabulary_prefiltered"] = ORACLES["vocabulary"]
