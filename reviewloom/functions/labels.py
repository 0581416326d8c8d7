"""Labels from ratings, label indices, and the text a model reads."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import strip
from reviewloom.schema import INVALID, LABELS, NEGATIVE, NEUTRAL, POSITIVE, STARS


def _col(c):
    return c if isinstance(c, Column) else F.col(c)


def star_sentiment(stars) -> Column:
    """1, 2 Negative; 3 Neutral; 4, 5 Positive; all else, NULL too, Invalid."""
    s = _col(stars)
    return (
        F.when(s.isin(1, 2), NEGATIVE)
        .when(s == 3, NEUTRAL)
        .when(s.isin(4, 5), POSITIVE)
        .otherwise(INVALID)
    )


def rating_sentiment(rating) -> Column:
    """Up to 2 Negative; exactly 3 Neutral; all else, 2.5 and NULL too, Positive."""
    r = _col(rating)
    return F.when(r <= 2, NEGATIVE).when(r == 3, NEUTRAL).otherwise(POSITIVE)


def valid_stars(stars) -> Column:
    return F.coalesce(_col(stars).isin(*STARS), F.lit(False))


def label_index(label) -> Column:
    """Index in ``LABELS``; NULL for any other label."""
    c = _col(label)
    index = F.when(c == LABELS[0], 0.0)
    for i, name in enumerate(LABELS[1:], 1):
        index = index.when(c == name, float(i))
    return index


def label_name(index) -> Column:
    c = _col(index)
    name = F.when(c == 0, LABELS[0])
    for i, label in enumerate(LABELS[1:], 1):
        name = name.when(c == i, label)
    return name


def text_representation(option, title="review_title", body="review_body") -> Column:
    """Option ``A``: the body. Option ``B``: title, a space and the body, stripped."""
    b = F.coalesce(_col(body), F.lit(""))
    if option == "A":
        return b
    if option == "B":
        return strip(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), b))
    raise ValueError(f"text option must be 'A' or 'B', not {option!r}")


def correct_flag(predicted="predicted_sentiment", expected="expected_sentiment") -> Column:
    return _col(predicted).eqNullSafe(_col(expected))


def invalid_star_filter(reviews, stars="stars"):
    """The rows whose stars are not 1 to 5."""
    return reviews.filter(~valid_stars(stars))


def normalize_reviews(reviews, title="review_title", body="review_body"):
    """NULL texts become empty; title and body lose outer whitespace."""
    return reviews.withColumns(
        {
            title: strip(F.coalesce(F.col(title), F.lit(""))),
            body: strip(F.coalesce(F.col(body), F.lit(""))),
        }
    )
