"""Text rules as column functions: no Python runs on the executors."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords, and those that questions have besides.
STOPWORDS = "the a an and or but to of in on for with is are was were be been being as at by it this that these those from into about over under i you we they he she them us my your our".split()
QUESTION_WORDS = "does say says tell me what when where how why please".split()


def clean_ws(x: Column) -> Column:
    """Null to empty, runs of any blanks to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def strip(x: Column) -> Column:
    """Without blanks at both ends; the search for the last character goes back from the end."""
    return F.regexp_extract(x, r"(?Us)^\s*(.*\S)", 1)


def normalize(x: Column) -> Column:
    """Lower case, with everything but a-z, 0-9, blanks and hyphens turned to a space."""
    return clean_ws(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s-]", " "))


def keywords(question: Column, most: int = 10, question_words: bool = True) -> Column:
    """The first distinct words of three letters or more that are neither stopwords nor numbers."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS + QUESTION_WORDS * question_words))
    good = lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")
    return F.slice(F.array_distinct(F.filter(F.split(normalize(question), " "), good)), 1, most)


def reference(text: Column, prefix: str, series: str = r"6\d{3}") -> tuple[Column, Column]:
    """(base, full) of a reference number such as `6000-1` after ``prefix``; nulls where there is none."""
    t = F.coalesce(text, F.lit(""))
    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    exact, five, base = (rf"(?iU)\b{prefix}\s*{rest}\b" for rest in (rf"({series})\s*[-–—]?\s*(\d)", rf"({series})(\d)", rf"({series})"))
    full = F.coalesce(F.concat_ws("-", part(exact, 1), part(exact, 2)), F.lit(""))
    return F.coalesce(part(exact, 1), part(five, 1), part(base, 1)), F.nullif(full, F.lit(""))


def rewrite_question(question: Column, prefix: str, most: int = 10) -> dict[str, Column]:
    """The columns of a rewritten question: its keywords after its reference number, or the question itself where it has none."""
    original = clean_ws(question)
    base, full = reference(original, prefix)
    words = keywords(original, most)
    compact = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(original)
    number = F.coalesce(full, base)
    query = clean_ws(F.when(number.isNull(), compact).otherwise(F.concat_ws(" ", F.lit(prefix), number, compact)))
    return {"original_question": original, "clean_query": query, "ref_base": base, "ref_full": full, "keywords": words}


def clean_section_title(title: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(title, F.lit(""))), r"^\s*\d+\s*[.)\-:]\s*", ""))


def text_hash(x: Column) -> Column:
    return F.sha2(F.coalesce(x, F.lit("")), 256)


def short_id(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts joined by `|`; a null part is an empty one."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def netloc(url: Column) -> Column:
    """Host with user and port; null where there is none."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def truncate(x: Column, most: int) -> Column:
    """At most so many characters, without blanks at the end of what is cut."""
    return F.when(F.length(x) > most, F.regexp_replace(F.substring(x, 1, most), r"(?U)\s+$", "")).otherwise(x)


def without_ellipsis(x: Column) -> Column:
    return strip(F.regexp_replace(strip(x), r"(?U)\s*(\.\.\.|…)\s*$", ""))


def state_text(x: Column) -> Column:
    """A state such as `(under review)` without its parentheses; null where nothing is left."""
    bare = strip(x)
    inside = F.when(bare.startswith("(") & bare.endswith(")"), strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    return F.nullif(inside, F.lit(""))


def sections_text(sections: Column) -> Column:
    """Titles and texts of a document's sections, one after another."""
    part = lambda s: strip(F.concat(F.coalesce(s["title"], F.lit("")), F.lit(" "), F.coalesce(s["text"], F.lit(""))))
    return strip(F.array_join(F.filter(F.transform(sections, part), lambda x: x != ""), " "))


def prompt(template: str, **columns: Column) -> Column:
    """The template with each `{name}` replaced by the column given under that name; nulls are empty."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def second(at: Column | None = None) -> Column:
    """A point in time, now if none is given, as UTC text to the second."""
    return F.date_format(F.date_trunc("second", F.current_timestamp() if at is None else at), "yyyy-MM-dd'T'HH:mm:ssXXX")


def section_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit(":s"), F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string")))


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")).cast("int")


def spaced(text: Column) -> Column:
    """A lower-cased text whose words, hyphens among them, stand between blanks, so that whole_word() finds them."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_-]", " ")
    return F.concat(F.lit(" "), F.replace(words, F.lit("-"), F.lit(" - ")), F.lit(" "))


def whole_word(spaced_text: Column, word: Column) -> Column:
    """Whether a keyword, of a-z, 0-9 and hyphens, occurs as a whole word."""
    return F.contains(spaced_text, F.concat(F.lit(" "), F.replace(word, F.lit("-"), F.lit(" - ")), F.lit(" ")))


#: Names of types and what they stand for.
ENTITY_TYPES = {"": "Concept", "concept": "Concept", "date": "Date", "time": "Date", "location": "Location", "place": "Location", "org": "Organization", "organization": "Organization", "organisation": "Organization", "person": "Person", "people": "Person"}


def entity_type(t: Column) -> Column:
    """The usual types under one name; of others only the first letter becomes upper case."""
    clean = clean_ws(t)
    names = F.create_map(*(F.lit(x) for pair in ENTITY_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(clean)), F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30)))


def json_object(text: Column) -> Column:
    """The first JSON object in a model's answer, as a variant: a fenced one, or from the first brace to the last; null if neither parses."""
    t = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.try_parse_json(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")))
    return F.coalesce(found(r"(?s)```json\s*(\{.*?\})\s*```"), found(r"(?s)(\{.*\})"))


def json_list(value: Column, path: str) -> Column:
    """The elements of a list in a variant; no elements where there is no list."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def json_text(value: Column, path: str = "$") -> Column:
    """A field of a variant as clean text; what counts as false (0, false, null, an empty text) is empty."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.try_variant_get(value, path, "string")
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    said = F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.when(text == "true", "True")).when(number & (F.try_variant_get(value, path, "double") == 0), "").otherwise(text)
    return clean_ws(said)
