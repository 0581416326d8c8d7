"""Is a text feedback on a product at all?"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import SPACE, WORD_CHAR, strip

# Words that mark product feedback.
PRODUCT_WORDS = tuple(
    """
    product item quality battery phone package delivery order seller purchase
    price support feature performance sound screen build material device unit
    software app service shipping box refund return warranty customer brand
    charge charger camera laptop book earphone headphone size color fit
    durability speed amazon store buy bought packaging value money cost deal
    discount merchandise goods hardware model working arrived defective
    """.split()
)

# Phrases that mark product feedback. Phrases with a word from
# the list above ("battery life", "don't buy") would add nothing.
PRODUCT_PHRASES = ("love this", "hate this", "recommend this")

# Patterns of health complaints, small talk, weather and trivia.
OUT_OF_DOMAIN = (
    r"feeling\s+(?:well|sick|bad|ill|good|better|terrible)",
    r"not\s+feeling\s+(?:well|good|ok|okay|great)",
    "headache", "fever", "stomach", "cough", "doctor", "hospital", "medicine",
    "sick", "illness", "pain", "weather", "raining", "sunny", "temperature",
    r"how\s+are\s+you", r"what\s+is\s+your\s+name", r"who\s+are\s+you",
    r"good\s+(?:morning|afternoon|evening|night)", r"capital\s+of",
    "president", r"prime\s+minister",
)

# Statuses and messages.
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

MIN_DISTINCT_WORDS = 3


def _whole(pattern):
    return rf"(?<!{WORD_CHAR}){pattern}(?!{WORD_CHAR})"


def _any_of(patterns):
    """Any of the patterns as whole words. They all start with a plain letter:
    testing the next letter first halves the time of the search."""
    initials = "".join(sorted({p[0] for p in patterns}))
    return f"(?=[{initials}])" + _whole(f"(?:{'|'.join(patterns)})")


def domain_gate(c) -> Column:
    """Struct of ``is_product_feedback``, ``domain_status`` and ``message``.

    A product mention beats any other sign; without one, an out-of-domain
    pattern or fewer than three distinct words rejects the text.
    """
    text = c if isinstance(c, Column) else F.col(c)
    lower = F.lower(strip(F.coalesce(text, F.lit(""))))
    mention = lower.rlike(_any_of(PRODUCT_WORDS + PRODUCT_PHRASES))
    off_topic = lower.rlike("(?U)" + _any_of(OUT_OF_DOMAIN).replace(r"\s", SPACE))
    words = F.regexp_extract_all(lower, F.lit(_whole("[a-z]{2,}+")), F.lit(0))
    few_words = F.size(F.array_distinct(words)) < MIN_DISTINCT_WORDS

    message = (
        F.when(lower == "", EMPTY_MESSAGE)
        .when(mention, VERIFIED_MESSAGE)
        .when(off_topic, OFF_TOPIC_MESSAGE)
        .when(few_words, TOO_SHORT_MESSAGE)
        .otherwise(ACCEPTED_MESSAGE)
    )
    return _from_message(message)


def _from_message(message) -> Column:
    accepted = message.isin(VERIFIED_MESSAGE, ACCEPTED_MESSAGE)
    return F.struct(
        accepted.alias("is_product_feedback"),
        F.when(accepted, ACCEPTED).otherwise(REJECTED).alias("domain_status"),
        message.alias("message"),
    )
