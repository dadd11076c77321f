"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only; no shuffle, one row out for each row in.

Results for odd input: a null text counts as empty; an empty text has no spans; repeated rows and
null ids give a row each; an empty table gives no rows; further columns, whatever their names, stay
beside the added one (out replaces a column of its name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import Kind, digest_columns, digits, let, luhn, mod97, with_spans

#: Fixed patterns of the base kinds, written so that a run is entered at its first place only.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Account numbers, in groups of four or without spaces.
IBAN = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
    r"(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
)
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"

#: Words that raise the score of a span they stand near.
NEAR = {
    "email": r"e-?mail|contact|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|master|amex|karte|carte|tarjeta|credit",
    "phone": r"phone|call|tel|mobile|fax|telefon|appel|llam",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social\s+security|tax\s+id",
}


def _length_between(match: Column, least: int, most: int) -> Column:
    return F.length(digits(match)).between(least, most)


def _account(match: Column) -> Column:
    """The longest confirmed part of an account-number match: whole, or without its last short group."""
    bare = lambda m: F.replace(m, F.lit(" "), F.lit(""))
    good = lambda m: F.length(bare(m)).between(15, 34) & mod97(bare(m))
    return let(
        F.regexp_replace(match, r"\x20[A-Z0-9]{1,3}$", ""),
        lambda short: F.when(good(match), match).when(good(short), short).otherwise(F.lit("")),
    )


KINDS = [
    Kind("email", EMAIL, prior=0.9, context=NEAR["email"], boost=0.1),
    Kind("ip", IP, keep=lambda m: m.rlike(IP_PARTS), prior=0.6, context=NEAR["ip"], boost=0.3),
    Kind(
        "card",
        CARD,
        keep=lambda m: F.when(_length_between(m, 12, 19), luhn(m)).otherwise(F.lit(False)),
        prior=0.7,
        context=NEAR["card"],
        boost=0.3,
    ),
    Kind("phone", PHONE, keep=lambda m: _length_between(m, 9, 15), prior=0.7, context=NEAR["phone"], boost=0.3),
    Kind("iban", IBAN, cut=_account, base=False, prior=0.9, context=NEAR["iban"], boost=0.1, least=0.5),
    Kind("ssn", SSN, base=False, prior=0.3, context=NEAR["ssn"], boost=0.6, least=0.5),
]


def pii_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with out: array<struct<start, rank, end, kind, value, score>>.

    Base kinds (email, ip, card, phone) are always kept and context only moves their score; account
    numbers need mod 97, and social-security numbers a context word, to be reported at all.
    """
    return with_spans(docs, F.col(f"`{text}`"), KINDS, out)


def pii_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and the highest score of a row's spans."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spans = F.col("pii")
    return pii_spans(rows).select(
        "doc_id",
        *digest_columns(spans, KINDS),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
