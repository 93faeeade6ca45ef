"""Text expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_-]+"
TOKEN = "[\\p{L}\\p{N}_-]+|[^\\s\\p{L}\\p{N}_-]+"
PUNCTUATION = "^[!-/:-@\\[-`{-~]+$"


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space, or at the end; trimmed, without empty ones."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   ")
    return F.filter(F.transform(F.split(flat, "(?<=[.!?]) +"), lambda s: F.trim(s)), lambda s: s != "")


def tokens(sentence: Column) -> Column:
    """Runs of letters, digits, _ and -, and runs of other visible characters."""
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def is_punctuation(token: Column) -> Column:
    return token.rlike(PUNCTUATION)


def tag(word: Column, place: Column) -> Column:
    """d number, u mixed or odd, a all upper case, n capitalised inside a sentence, p plain."""
    digits = F.regexp_replace(F.regexp_replace(word, ",", ""), "^([^.]*)\\.([^.]*)$", "$1$2")
    marks = F.length(word) - F.length(F.regexp_replace(word, "[!-/:-@\\[-`{-~]", ""))
    has_digit, has_letter = word.rlike("\\p{Nd}"), word.rlike("\\p{L}")
    return (
        F.when(word.rlike("^\\p{Ll}+\\z"), "p")  # most words: no other rule can hold
        .when(digits.rlike("^\\p{Nd}+\\z"), "d")
        .when((has_digit & has_letter) | (~has_digit & ~has_letter) | (marks > 1), "u")
        .when(word.rlike("\\p{Lu}") & ~word.rlike("\\p{Ll}"), "a")
        .when((F.length(word) > 1) & (place > 0) & word.rlike("^\\p{Lu}[^\\p{Lu}]*\\z"), "n")
        .otherwise("p")
    )


def normalise(word: Column) -> Column:
    """Lower case, without the final s of words over three characters."""
    low = F.lower(word)
    return F.when((F.length(low) > 3) & low.endswith("s"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over code points."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def word_set(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+")), "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def fingerprint(skeleton: Column) -> Column:
    """SHA-256 of the lower-case text with single spaces."""
    return F.sha2(F.lower(collapse(skeleton)), 256)


def lexer(text: Column) -> Column:
    """Quoted strings with their quotes, and words with inner dots or hyphens; a quote that isn't closed begins a word that goes on to the end."""
    return F.regexp_extract_all(text, F.lit('"[^"]*"|"[^"]*\\z|[\\p{L}\\p{N}_-]+(?:\\.[\\p{L}\\p{N}_-]+)*'), F.lit(0))


def skeleton(text: Column, known: Column, form: Callable[[Column], Column] = F.lower) -> Column:
    """Struct of the text with <ENT> for quoted and unknown words, and the lower-case entities in order.

    A word is known if its ``form`` is: lower case for lists of words, ``stem`` for lists of stems.
    """
    parts = lexer(F.coalesce(text, F.lit("")))
    quoted = lambda t: t.rlike('(?s)^".*"\\z') & (F.length(t) > 1)
    unknown = lambda t: quoted(t) | ~F.array_contains(known, form(t))
    return F.struct(
        F.array_join(F.transform(parts, lambda t: F.when(unknown(t), F.lit("<ENT>")).otherwise(t)), " ").alias("skeleton"),
        F.transform(F.filter(parts, unknown), lambda t: F.lower(F.when(quoted(t), F.replace(t, F.lit('"'), F.lit(""))).otherwise(t))).alias("entities"),
    )


def skill_name(name: Column) -> Column:
    """Non-alphanumeric characters become _, ASCII letters lower case."""
    return F.translate(F.regexp_replace(name, "[^\\p{L}\\p{N}]", "_"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def skill_file(path: Column) -> Column:
    """The skill file of one of its index files: last segment, without _index_N.idx, with .md."""
    return F.concat(F.regexp_extract(path, "([^/\\\\]+)_index_[^_/\\\\]*\\.idx$", 1), F.lit(".md"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]+?)(?:\\.[^./\\\\]*)?$", 1)


def frontmatter(content: Column) -> Column:
    """Struct of name, description and body; null without a closed front matter that has both keys. The last key of a name counts."""
    head = "(?s)^\\x{FEFF}?---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)(.*)$"
    block, body = F.regexp_extract(content, head, 1), F.regexp_extract(content, head, 2)
    value = lambda key: F.regexp_extract(block, f"(?s)^(?:.*\\n)?{key}:[ \\t]*([^\\n]*)", 1)
    name, description = F.trim(value("name")), F.trim(value("description"))
    return F.when((name != "") & (description != ""), F.struct(name.alias("name"), description.alias("description"), body.alias("body")))


def strip_frontmatter(content: Column) -> Column:
    return F.regexp_replace(content, "(?s)^\\x{FEFF}?---[ \\t]*\\r?\\n.*?\\r?\\n---[ \\t]*(?:\\r?\\n|$)", "")


def tool_calls(text: Column) -> Column:
    """The JSON after the first TOOL_CALLS: as an array of (name, arguments); null if there is none or it is broken."""
    found = F.when(text.contains("TOOL_CALLS:"), F.regexp_extract(text, "(?s)TOOL_CALLS:(.*)$", 1))
    return F.from_json(F.trim(found), "array<struct<name:string,arguments:string>>")


def injection(calls: Column) -> Column:
    """Numbered list of calls; arguments of over 200 bytes are cut to 200 characters and dots."""
    cut = lambda a: F.when(F.octet_length(a) > 200, F.concat(F.substring(a, 1, 200), F.lit("..."))).otherwise(a)
    return F.array_join(F.transform(calls, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["name"], F.lit(" "), cut(c["arguments"]))), "\n")


def rebukes(content: Column) -> Column:
    """Texts between separator lines ---[...]--------."""
    parts = F.split(F.coalesce(content, F.lit("")), "(?m)^---\\[[^\\]]*\\]-+[ \\t]*$")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")


def with_rebukes(system: Column, texts: Column) -> Column:
    """The system text and the rebukes, each closed with a full stop unless it has an end mark."""
    closed = lambda x: F.when(x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))
    return F.array_join(F.concat(F.array(system), F.transform(texts, closed)), " ")


def strip_fences(text: Column) -> Column:
    inner = F.regexp_extract(text, "(?s)^\\s*```[^\\n]*\\n(.*?)\\n?```\\s*$", 1)
    return F.when(text.rlike("(?s)^\\s*```.*```\\s*$"), inner).otherwise(text)


def is_comment(line: Column) -> Column:
    return F.trim(line).rlike("^(//|/\\*|\\*|#|--|;;|%%)")


def clean_comment(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), "^(/{2,}!?|/\\*+|\\*+/?|#+|--+|;;+|%%+)", ""), "\\*+/$", ""))


def format_bytes(n: Column) -> Column:
    """Exact ties go to the even digit."""
    kb, mb = F.bround(n / 1024.0, 1), F.bround(n / 1048576.0, 2)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.2f MB", mb))


def ensure_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("http://"), url))


def ok_content(content: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("ok"), content.alias("content")))


def failure(error: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error")))


def is_success(result: Column) -> Column:
    """A tool result with neither the failure flag nor the prefix of an error message (a fixed value)."""
    return ~result.contains('"ok":false') & ~result.startswith("Ошибка")


def first_of(json: Column, *keys: str) -> Column:
    """The first key that is there, as text; else empty."""
    return F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys), F.lit(""))


#: Endings of Russian nouns, adjectives and verbs that a light stemmer strips.
RUSSIAN_ENDINGS = (
    "иями ями ами иях ях ах иям ям ам ов ев ей ий ый ой ая яя ое ее ые ие ого его ому ему ым им ых их ую юю ия ию ии "
    "ешь ишь ете ите ет ит ют ут ят ат ть ла ло ли а я о е и ы у ю ь"
)


def stem(word: Column) -> Column:
    """A light suffix stripper that leaves three letters at least: Russian endings of words with a Cyrillic letter, else English plural, -ing, -ed, -ly."""
    low = F.lower(word)
    russian = F.regexp_replace(low, f"(?<=\\p{{L}}{{3}})({RUSSIAN_ENDINGS.replace(' ', '|')})$", "")
    english = F.regexp_replace(F.regexp_replace(low, "(?<=\\p{L}{3})(ing|ed|ly)$", ""), "(?<=\\p{L}{3})s$", "")
    return F.when(low.rlike("[а-яё]"), russian).otherwise(english)


def ordered_union(*lists: Column) -> Column:
    """Elements of all lists in order of their first place; a null list is empty."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def project_name(name: Column) -> Column:
    """Lower-case letters, digits and _ of ASCII; each other character becomes _, and nothing becomes default."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(name, "[^A-Za-z0-9_]", "_")), F.lit("")), F.lit("default"))


def project_id(name: Column, at: Column) -> Column:
    """The project's name and the time of its beginning."""
    return F.concat(project_name(name), F.lit("_"), F.date_format(at, "yyyy-MM-dd_HH-mm-ss"))


def without_fences(text: Column) -> Column:
    """What stands between an opening fence of three backticks (json or not) and the last closing one, trimmed; other texts are trimmed."""
    space = "^\\s+|\\s+$"
    t = F.regexp_replace(text, space, "")
    inner = F.regexp_replace(F.regexp_replace(t, "^```(?:json|JSON)?", ""), "^[\\r\\n]+", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(inner, "(?s)^(.*)```.*$", "$1"), space, "")).otherwise(t)


def shortened(text: Column, most: int) -> Column:
    """Texts over ``most`` bytes become their first ``most`` characters and three points."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))
