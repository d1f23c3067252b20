"""Text expressions: whitespace words, word windows, tokens, overlap, chunk ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which characters separate words and which form tokens.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN = "[a-z0-9]+"
TOKEN_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
ID_HEX_DIGITS = 12


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer inlines a projected expression into lambda bodies that use it, where it would
    run again for every element. A one-element array pins it to a lambda variable.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARACTERS))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    trimmed = strip(text)
    empty = F.array().cast("array<string>")
    return F.when(trimmed == "", empty).otherwise(F.split(trimmed, f"{WHITESPACE}+"))


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"window size must be positive, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be in 0..{size - 1}, got {overlap}")


def window_count(n_words: Column, size: int, overlap: int) -> Column:
    """Number of windows over ``n_words`` words.

    Windows start every ``size - overlap`` words. The last one is dropped if it holds nothing
    beyond its predecessor; only that one, even when a large overlap makes others redundant.
    """
    step = size - overlap
    starts = F.ceil(n_words / F.lit(step)).cast("int")
    redundant = (starts > 1) & (n_words <= (starts - 1) * step + overlap)
    return starts - redundant.cast("int")


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """``array<struct<chunk_index:int, text:string>>`` of overlapping word windows.

    The windows are cut inside the row, so a long document is walked once and its word list is
    never copied to each of its chunks.
    """
    check_window(size, overlap)
    step = size - overlap

    def cut(w: Column) -> Column:
        n = window_count(F.size(w), size, overlap)
        return F.when(
            n > 0,
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.struct(
                    i.alias("chunk_index"),
                    F.array_join(F.slice(w, i * step + 1, size), " ").alias("text"),
                ),
            ),
        )

    return bind(words(text), cut)


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    """``doc#index-hash``: stable across runs, changed by any change of text or position."""
    i = index.cast("string")
    digest = F.sha1(F.concat(doc_id, F.lit(":"), i, F.lit(":"), text).cast("binary"))
    return F.concat(doc_id, F.lit("#"), i, F.lit("-"), F.substring(digest, 1, ID_HEX_DIGITS))


def path_order(doc_id: Column) -> Column:
    """Sort key that orders ids as file paths, folder by folder."""
    return F.translate(doc_id, "/", "\x01")


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def lower_bytes(text: Column) -> Column:
    """A text as ``tokens_of`` takes it: in lower case, as UTF-8."""
    return F.lower(text).cast("binary")


def tokens_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """``token_list`` of each text of an Arrow batch made by ``lower_bytes``; NULL has no tokens."""
    for text in texts:
        yield text.as_py().translate(TOKEN_BYTES).split() if text.is_valid else []


def token_set(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def overlap_of_sets(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's distinct tokens that the text holds; 0 for a query without tokens."""
    n = F.size(query_tokens)
    shared = F.size(F.array_intersect(query_tokens, text_tokens))
    return F.when(n == 0, F.lit(0.0)).otherwise(shared.cast("double") / n)


def lexical_overlap(query: Column, text: Column) -> Column:
    return bind(token_set(query), lambda q: overlap_of_sets(q, token_list(text)))
