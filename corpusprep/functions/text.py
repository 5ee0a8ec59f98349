"""String and token-array Column builders (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .rng import uniform

# Whitespace that separates words (same class in Java and RE2 regex).
WS_RE = r"[ \t\n\r\f]+"
# Special markers such as <|eot_id|> are always tokens of their own.
MARKER_RE = r"(<\|[a-z_0-9]+\|>)"
MARKER_FULL_RE = r"^<\|[a-z_0-9]+\|>$"
# SELFIES alphabet symbols: one bracketed group each.
SELFIES_RE = r"(\[[^\]]*\])"
# Leading/trailing whitespace, as a template ``trim`` filter strips it.
EDGE_WS_RE = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def tokens(text: Column) -> Column:
    """Whitespace word tokens with special markers split out.

    All built-ins (code-generated): the marker regex only runs on texts that
    contain ``<|``, and empty pieces are dropped with ``array_remove``."""
    t = F.coalesce(text, F.lit(""))
    spaced = F.when(t.contains("<|"), F.regexp_replace(t, MARKER_RE, " $1 ")).otherwise(t)
    return F.array_remove(F.split(spaced, WS_RE), "")


def selfies_tokens(text: Column) -> Column:
    """Bracketed SELFIES symbols in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SELFIES_RE), 1)


def is_marker(tok: Column) -> Column:
    """Whole token is a special marker (cheap prefix test before the regex)."""
    return tok.startswith("<|") & tok.rlike(MARKER_FULL_RE)


def strip_ws(text: Column) -> Column:
    """Whitespace trim on both ends (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(text, EDGE_WS_RE, "")


def html_escape(text: Column) -> Column:
    """Escape ``& < > " '`` (ampersand first, quote=True semantics)."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#x27;"))


PERSON_RUN_RE = r"(?i)<person>([,\s]*(and)*[,\s]*<person>)+"
PERSON_RE = r"(?i)<person>"


def scrub_person_tags(text: Column, key: Column, seed: int = 0, rng: str = "portable") -> Column:
    """C4: runs of ``<person>`` tags become " people "; every remaining tag
    (any case) becomes " <word> " with the word drawn by ``u('person', key, i)``
    for the i-th remaining tag."""
    words = F.array(*[F.lit(w) for w in K.PERSON_WORDS])
    collapsed = F.regexp_replace(text, PERSON_RUN_RE, " people ")
    parts = F.split(collapsed, PERSON_RE)
    n = len(K.PERSON_WORDS)
    pieces = F.transform(
        parts,
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(
                F.lit(" "),
                F.get(words, F.floor(F.lit(n) * uniform("person", key, i - 1, seed=seed, rng=rng)).cast("int")),
                F.lit(" "),
                p,
            )
        ),
    )
    return F.when(text.isNull(), text).otherwise(F.array_join(pieces, ""))
