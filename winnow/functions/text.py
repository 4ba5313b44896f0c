"""Tokenisers and text helpers: Python functions from Column to Column, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Not a letter, digit or underscore, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"

#: English stopwords (fixed values).
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing would should could ought "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off "
    "over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very"
).split(" ")

Replacement = tuple[str, str]


def replaced(text: Column, *steps: Replacement) -> Column:
    """Regular expression replacements, one after the other."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, text)


def squished(text: Column) -> Column:
    """Outer white space removed, inner runs made one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cleaned(text: Column) -> Column:
    """A record's text field: tight separators, no quotes, squished; empty and "NA" are null."""
    text = squished(replaced(text, (" *; *", ";"), ("[\"']+", " ")))
    return F.when(~text.isin("", "NA"), text)


def title_key(title: Column) -> Column:
    """Lower-cased letters and digits only: the key that duplicates share."""
    return F.regexp_replace(F.lower(title), NON_WORD, "")


def loose_title_key(title: Column) -> Column:
    """Like ``title_key``, but spaces stay."""
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]+", "")


def lemmatised(tokens: Column, lemmas: dict[str, str] | None) -> Column:
    """Each token's lemma where the table (token to lemma) has its lower-case form, else the token."""
    if not lemmas:
        return tokens
    table = F.create_map(*(F.lit(x) for pair in lemmas.items() for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t))


def tokenized_text(text: Column, stopwords: list[str] | None = None, lemmas: dict[str, str] | None = None) -> Column:
    """Title or abstract as space-joined tokens.  Hyphens are kept through the stopword step, so that
    parts of compounds survive; possessive and contracted endings go with their apostrophe."""
    words = STOPWORDS if stopwords is None else stopwords
    text = F.regexp_replace(F.lower(text), "-", "_")
    if words:
        text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])(" + "|".join(words) + r")(?![\p{L}\p{N}_])", "")
    text = replaced(text, (r"'((s|re|t|d)(?![\p{L}\p{N}_])|(?=[\p{L}\p{N}_])|)", ""), ("_", " "), (r"[^\p{L}\p{N}\s]+", " "))
    text = squished(text)
    if lemmas:
        text = F.array_join(lemmatised(F.split(text, " "), lemmas), " ")
    return F.when(text != "na", text)


def _initials(names: Column) -> Column:
    return F.array_join(F.regexp_extract_all(names, F.lit(r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_])"), 1), "")


def tokenized_authors(authors: Column) -> Column:
    """"Last, Given Names; ..." or "G. N. Last; ..." as space-joined Last_GN tokens."""
    people = lambda x: F.filter(F.split(x, ";"), lambda p: F.trim(p) != "")

    def comma(person: Column) -> Column:
        last, given = F.substring_index(person, ",", 1), F.regexp_extract(person, r"^[^,]*,(.*)$", 1)
        return F.regexp_replace(F.when(F.contains(person, F.lit(",")), F.concat(last, F.lit("_"), _initials(given))).otherwise(person), "[ ,]+", "")

    def dotted(person: Column) -> Column:
        bare = F.regexp_replace(person, r"[^\p{L}\p{N}_.]", "")
        first, last = F.regexp_extract(bare, r"^(.+)\.([^.]+)$", 1), F.regexp_extract(bare, r"^(.+)\.([^.]+)$", 2)
        return F.regexp_replace(F.when(last != "", F.concat(last, F.lit("_"), first)).otherwise(bare), r"\.", "")

    authors = squished(authors)
    with_comma = F.array_join(F.transform(people(F.regexp_replace(authors, r"[^\p{L}\p{N}_ ,;]", "")), comma), " ")
    return F.when(F.contains(authors, F.lit(",")), with_comma).otherwise(F.array_join(F.transform(people(authors), dotted), " "))


def tokenized_keywords(keywords: Column) -> Column:
    """";"-separated keywords as space-joined tokens; inner gaps become underscores."""
    return replaced(F.lower(keywords), (r"\s*;\s*", ";"), (r"[^;\p{L}\p{N}_]+", "_"), (";", " "))


def tokenized_mesh(mesh: Column) -> Column:
    """";"-separated headings as tokens; "A/b/c" gives A, A.sh.b and A.sh.c."""
    parts = F.split(replaced(mesh, (" *; *", ";"), (r"[()]", ""), (r"[ ,\-]+", "_"), ("&", "and")), ";")

    def expanded(heading: Column) -> Column:
        pieces = F.split(heading, "/")
        head = F.get(pieces, 0)
        subs = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda s: F.concat(head, F.lit(".sh."), s))
        return F.when((F.size(pieces) > 1) & (head != ""), F.concat(F.array(head), subs)).otherwise(F.array(heading))

    return squished(F.array_join(F.flatten(F.transform(parts, expanded)), " "))


#: Fields of the document-term tables: label, tokeniser, and whether n-grams and synonyms are mined.
FIELDS = {
    "TITLE": ("Title", tokenized_text, True, True), "ABSTR": ("Abstract", tokenized_text, True, True), "AUTH": ("Authors", tokenized_authors, False, False),
    "KEYS": ("Keywords", tokenized_keywords, True, True), "MESH": ("Mesh", tokenized_mesh, False, True),
}
