"""Citation expressions: ids in square brackets, checked against the provided passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citesift.functions.text import bind

# A bracket without brackets inside, and what separates ids within one bracket.
BRACKETED = r"\[([^\[\]]+)\]"
ID_SEPARATOR = r"[\t-\r\x1c-\x20\x85\p{Z},;]+"


def extract_citations(answer: Column) -> Column:
    """All cited ids in order, with repeats. A token is an id if a ``#`` lies strictly inside it."""
    tokens = F.flatten(
        F.transform(
            F.regexp_extract_all(answer, F.lit(BRACKETED), 1),
            lambda body: F.split(body, ID_SEPARATOR),
        )
    )
    return F.filter(
        tokens,
        lambda t: F.contains(t, F.lit("#")) & ~F.startswith(t, F.lit("#")) & ~F.endswith(t, F.lit("#")),
    )


def grounding_score(answer: Column, provided_ids: Column) -> Column:
    """``struct<has_citation, valid_fraction, n_citations>`` of one answer.

    Without citations nothing is invalid (1.0). With citations but no passages all are (0.0). A NULL
    answer cites nothing and counts as ungrounded (0.0).
    """

    def score(cited: Column) -> Column:
        n = F.size(cited)
        valid = F.size(F.filter(cited, lambda c: F.array_contains(provided_ids, c)))
        return F.struct(
            (n > 0).alias("has_citation"),
            F.when(n > 0, valid.cast("double") / n).otherwise(F.lit(1.0)).alias("valid_fraction"),
            n.alias("n_citations"),
        )

    missing = F.struct(
        F.lit(False).alias("has_citation"), F.lit(0.0).alias("valid_fraction"), F.lit(0).alias("n_citations")
    )
    return F.when(answer.isNull(), missing).otherwise(bind(extract_citations(answer), score))


def id_survives_citation(chunk_id: Column) -> Column:
    """True if the id, put in brackets, is read back as exactly itself."""
    cited = F.concat(F.lit("["), chunk_id, F.lit("]"))
    return F.coalesce(extract_citations(cited) == F.array(chunk_id), F.lit(False))


