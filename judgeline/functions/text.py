"""Column expressions on text: tokens, normal forms, chunks, sections. All of them run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that the token-set and normal forms turn into spaces.
PUNCTUATION = "¿?¡!,.:;"
# The letters of a word for difficulty features.
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"


def _accents() -> tuple[str, str]:
    """Every letter of the basic plane that decomposes into a letter and combining marks, and that letter."""
    found = {}
    for c in map(chr, range(0x80, 0x10000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.category(parts[0])[0] == "L" and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            found[c] = parts[0]
    return "".join(found), "".join(found.values())


ACCENTED, UNACCENTED = _accents()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize_ws(text: Column | str, lower: bool = True) -> Column:
    """Whitespace tokens, without empty ones."""
    text = F.coalesce(_col(text), F.lit(""))
    return F.filter(F.split(F.lower(text) if lower else text, r"\s+"), lambda t: t != "")


def tokenize_letters(text: Column | str) -> Column:
    """Lower-cased runs of letters."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"([{LETTERS}]+)"), F.lit(1))
    return F.transform(found, F.lower)


def normalize_text(text: Column | str) -> Column:
    """Lower case, with the punctuation marks replaced by spaces."""
    return F.translate(F.lower(F.coalesce(_col(text), F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))


def token_set_punct(text: Column | str) -> Column:
    """Distinct tokens of the normal form."""
    return F.array_distinct(tokenize_ws(normalize_text(text), lower=False))


def strip_accents(text: Column | str) -> Column:
    """Accented letters to their base letter; combining marks are dropped."""
    return F.regexp_replace(F.translate(_col(text), ACCENTED, UNACCENTED), r"\p{Mn}", "")


def normalize_token(token: Column | str) -> Column:
    return F.regexp_replace(strip_accents(F.lower(_col(token))), "[^a-zA-Z]", "")


def word_count(text: Column | str) -> Column:
    """Pieces between single spaces."""
    return F.size(F.split(_col(text), " "))


def summary_budget(text: Column | str) -> Column:
    """Eight percent of the words, held between 128 and 512."""
    return F.least(F.lit(512), F.greatest(F.lit(128), F.floor(word_count(text) * 0.08).cast("int")))


def mandatory_terms(query: Column | str) -> Column:
    return F.transform(F.split(_col(query), ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))


# --- chunkers: Column -> ARRAY<STRING> -------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def word_windows(words: Column, length: int, stride: int) -> Column:
    """Joined windows of ``length`` words that start at 0, stride, 2 * stride, ... below the number of words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(stride))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(length)), " "))

    return let(words, lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(F.array().cast("array<string>")))


def chunk_sliding(text: Column | str, max_length: int = 512, stride: int | None = None) -> Column:
    """Windows of ``max_length`` words that start at every multiple of ``stride``, nested tails included."""
    return word_windows(tokenize_ws(text, lower=False), max_length, stride or max(max_length // 2, 1))


def chunk_fixed(text: Column | str, window_size: int = 256) -> Column:
    """Neighbouring windows of single-space pieces."""
    return word_windows(F.split(_col(text), " "), window_size, window_size)


def chunk_paragraphs(text: Column | str) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    parts = F.transform(F.split(_col(text), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def chunk_paragraph_pack(text: Column | str, max_words: int = 256) -> Column:
    """Paragraphs joined by a space while they stay within ``max_words``; a longer paragraph stands alone."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("words"))

    def step(state: Column, paragraph: Column) -> Column:
        size = F.size(tokenize_ws(paragraph, lower=False))
        joins = (state["words"] > 0) & (state["words"] + size <= max_words)
        flushed = F.when((state["words"] > 0) & ~joins, F.concat(state["done"], F.array(state["open"]))).otherwise(
            state["done"])
        return F.struct(
            flushed.alias("done"),
            F.when(joins, F.concat_ws(" ", state["open"], paragraph)).otherwise(paragraph).alias("open"),
            F.when(joins, state["words"] + size).otherwise(size).alias("words"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["words"] > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    return F.aggregate(chunk_paragraphs(text), start, step, finish)


def chunk_headers(text: Column | str, chunk_size: int = 256) -> Column:
    """The text again, cut into numbered sections that state their word range."""

    def sections(words: Column) -> Column:
        n = F.size(words)

        def section(chunk: Column, i: Column) -> Column:
            first = i * chunk_size
            last = F.least(first + chunk_size, n)
            return F.format_string("## CHUNK_%03d (words %d-%d)\n\n%s", i + 1, first + 1, last, chunk)

        return F.array_join(F.transform(word_windows(words, chunk_size, chunk_size), section), "\n\n")

    return let(tokenize_ws(text, lower=False), sections)


# --- identifiers -----------------------------------------------------------------------------------------------


def chunk_id(did: Column | str, idx: Column | str) -> Column:
    return F.concat(_col(did), F.lit("__chunk"), _col(idx).cast("string"))


def doc_id_of_chunk(cid: Column | str) -> Column:
    return F.substring_index(_col(cid), "__chunk", 1)


def qid_base(qid: Column | str) -> Column:
    """Part before the first underscore."""
    return F.substring_index(_col(qid), "_", 1)


def qid_suffix(qid: Column | str) -> Column:
    """Part after the last underscore."""
    return F.substring_index(_col(qid), "_", -1)


def topic_number(topic: Column | str) -> Column:
    """Id in front of the colon of ``id:query text``."""
    return F.substring_index(_col(topic), ":", 1)


# --- extraction ------------------------------------------------------------------------------------------------


def extract_numbers(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"(\d+)"), F.lit(1))


def extract_articles(text: Column | str) -> Column:
    """Numbers of article references such as ``Art. 12`` or ``Artículo 5``, whatever the case."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?iu)Art(?:[íi]culo)?\.?\s*(\d+)"), F.lit(1))


def extract_section(text: Column | str, header: str) -> Column:
    """Trimmed text after ``header`` and an optional colon or dash, whatever the case, else an empty string."""
    body = F.regexp_extract(_col(text), rf"(?isu){header}\s*[:-]?\s*(.+)", 1)
    return F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")


# The section titles of a structured summary, and the word that marks an unclear passage.
SUMMARY_SECTIONS = [
    "Identificación",
    "Hechos clave",
    "Pretensiones y agravios",
    "Cuestiones sometidas",
    "Decisión",
    "Fundamentos esenciales",
    "Resultado y efectos",
    "Citas relevantes",
]
UNCLEAR_MARK = "AMBIGUO"


def section_flags(text: Column | str, headers: list[str] | None = None, marker: str = UNCLEAR_MARK) -> list[Column]:
    """One 0/1 column per section title that ends a line, and how often the marker word occurs."""
    headers = SUMMARY_SECTIONS if headers is None else headers
    flags = [
        F.contains(_col(text), F.lit(h + "\n")).cast("int").alias(f"has_{i}") for i, h in enumerate(headers)]
    return [*flags, F.regexp_count(_col(text), F.lit(marker)).alias("n_unclear")]
