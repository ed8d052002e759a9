"""Text normalisation as column expressions, so that the optimizer sees through them.

Python's white space is Unicode's, Java's is ASCII's unless (?U) is set; it is set here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answer_tables import ARTICLES, CONSENSUS_PUNCTUATION, CONTRACTIONS, NUMBER_WORDS, PUNCTUATION, VERDICT_WORDS

LIST_PAGES = ("list of", "outline of", "index of")
EXCLUDED_SECTIONS = ("references", "external links", "see also", "notes", "bibliography", "further reading")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalize_title(c) -> Column:
    """Lower case, no parenthesised part, only a-z, 0-9 and single spaces; null gives an empty title."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    kept = F.regexp_replace(F.regexp_replace(low, r"\([^)]*\)", ""), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def url_to_title(c) -> Column:
    """The normalised title in a /wiki/ URL, empty if it has none. A plus sign is itself and a bad escape stays."""
    path = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"/wiki/([^#?]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return normalize_title(F.replace(plain, F.lit("_"), F.lit(" ")))


def is_list_page(title) -> Column:
    """Whether a normalised title names a list, an outline or an index."""
    t = normalize_title(title)
    return t.contains(LIST_PAGES[0]) | t.contains(LIST_PAGES[1]) | t.contains(LIST_PAGES[2])


def is_excluded_section(title, excluded: tuple[str, ...] = EXCLUDED_SECTIONS) -> Column:
    return strip(F.lower(col(title))).isin(*excluded)


def is_blank(c) -> Column:
    return ~F.coalesce(col(c), F.lit("")).rlike(r"(?U)\S")


def section_header(title, section, text) -> Column:
    """What a late-interaction encoder reads of a section."""
    return F.concat(F.lit("# Wiki Article: "), col(title), F.lit("\n## Section Title: "), col(section), F.lit("\n"), col(text))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def pre_caption(c, max_words: int = 50) -> Column:
    """Captions: some punctuation becomes a space, runs of white space one, at most max_words words."""
    x = F.regexp_replace(F.lower(col(c)), r'[.!"()*#:;~]', " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s{2,}", " "), r"\n+\z", "")
    return first_words(F.trim(x), max_words)


def pre_question(c, max_words: int = 50) -> Column:
    """Questions: the same punctuation goes, so do spaces at the end."""
    return first_words(F.rtrim(F.regexp_replace(F.lower(col(c)), r'[.!"()*#:;~]', "")), max_words)


def _mapped(words: Column, table: dict[str, str]) -> Column:
    values = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(values, w), w))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def normalize_answer(c) -> Column:
    """Free-text answers: lower case, no punctuation, no articles, digits for number words, contractions spelled out."""
    x = strip(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "\n\t", "  "))
    prefix = "<extra_id_0> "
    x = F.when(F.startswith(x, F.lit(prefix)), F.replace(x, F.lit(prefix), F.lit(""))).otherwise(x)
    x = F.regexp_replace(F.translate(x, PUNCTUATION, ""), r"(?U)\b(the answer is|a|an|the)\b", " ")
    return F.array_join(_mapped(_mapped(_words(x), NUMBER_WORDS | VERDICT_WORDS), CONTRACTIONS), " ")


def consensus_punctuation(c) -> Column:
    """Each mark is deleted if the text has it next to a space, or has a comma between
    digits; else it becomes a space. Then at most 32 full stops that no digit follows go."""

    def marks(text: Column) -> Column:
        comma = text.rlike(r"(?U)\d,\d")
        out = text
        for p in CONSENSUS_PUNCTUATION:
            beside = text.contains(p + " ") | text.contains(" " + p)
            out = F.replace(out, F.lit(p), F.when(beside | comma, F.lit("")).otherwise(F.lit(" ")))
        return out

    def stops(text: Column) -> Column:
        parts = F.split(text, r"(?U)\.(?!\d)")
        head = F.array_join(F.slice(parts, 1, 33), "")
        tail = F.array_join(F.slice(parts, 34, F.greatest(F.size(parts) - 33, F.lit(0))), ".")
        return F.when(F.size(parts) > 33, F.concat(head, F.lit("."), tail)).otherwise(head)

    return let(let(F.coalesce(col(c), F.lit("")), marks), stops)


def consensus_words(c) -> Column:
    """Lower case, digits for number words, no articles, contractions spelled out."""
    words = F.filter(_mapped(_words(F.lower(col(c))), NUMBER_WORDS), lambda w: ~w.isin(*ARTICLES))
    return F.array_join(_mapped(words, CONTRACTIONS), " ")


def consensus_answer(c) -> Column:
    return consensus_words(consensus_punctuation(strip(F.translate(F.coalesce(col(c), F.lit("")), "\n\t", "  "))))


def parse_ids(c) -> Column:
    """Ids of a `|` list; null, empty and "nan" give none."""
    x = F.coalesce(col(c), F.lit(""))
    return F.when(F.lower(x) == "nan", F.array().cast("array<string>")).otherwise(F.filter(F.split(x, r"\|"), lambda v: v != ""))
