"""Text functions as Column expressions: tokens, citations, sentences, claims, titles, issues, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the data formats read here.
FRONT_MATTER = r"(?s)\A---\r?\n.*?\r?\n---\r?\n"
MARKDOWN_H1 = r"(?m)^#[ \t]+(.+?)\s*$"
FENCED_CODE = r"(?ms)^ {0,3}(?<fence>`{3,}|~{3,}).*?(?:^ {0,3}\k<fence>[`~]*[^\S\n]*$|\z)"
INLINE_CODE = r"`+[^`\n]*`+"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "cf.", "vs.", "approx.")
SENTENCE_BOUNDARY = r"""(?<=[.!?])\s+(?=[A-Z(\[*`"'-]|\*\*)"""
LIST_MARKER = r"^\s*(?:[-*+]|\d+[.)])\s+"
HEADING_MARKER = r"^\s*#{1,6}\s+"
CLAIM_WORD = r"[A-Za-z][A-Za-z'-]*"
CONTEXT_REMARK = r"(?i)\b(?:provided\s+|retrieved\s+|given\s+)?(?:spans?|context|documentation provided)\b"
FIRST_PERSON_LIMIT = r"(?i)\b(?:I(?:'d| would)? (?:can'?t|cannot|could not|couldn'?t|need|rather not)|there is nothing in|I do not have|I don'?t have)\b"
CLI_FLAG = r"--[a-z0-9][a-z0-9-]*"
BACKTICKED = r"`([^`\n]+)`"
SNAKE_KEY = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"
ISSUE_PREFIX = r"(?i)^\s*\[(usage|doc|docs|question|feature|bug|installation)\]\s*:?\s*"
QUESTION_HEADING = r"(?im)^###\s+How would you like to use vllm\s*$"
ENVIRONMENT_HEADING = r"(?im)^###\s+Your current environment\s*$"
BOILERPLATE_HEADING = r"(?im)^###\s+Before submitting a new issue"
DOT = "\x00"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def tokens(text: Column) -> Column:
    """Words, each with the white space after it: joined they are the text from its first word on."""
    return F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


# The rules of Porter's stemmer, step 1 (M.F. Porter, An algorithm for suffix stripping, 1980), over lower-case ASCII words. A
# vowel is one of aeiou, or y after a letter that is none of them.
HAS_VOWEL = "[aeiou]|[^aeiou]y"
HAS_MEASURE = "[aeiou][^aeiou]|[^aeiou]y[^aeiou]"
SHORT_STEM = "^[^aeiou]+[aeiouy][^aeiouwxy]$"
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def stem(word: Column) -> Column:
    """A word without its plural, -ed or -ing, by the first step of Porter's rules; words of under three letters stay."""
    cut = lambda w, n: F.left(w, F.length(w) - n)
    plural = F.when(word.endswith("sses") | word.endswith("ies"), cut(word, 2)).when(word.endswith("s") & ~word.endswith("ss"), cut(word, 1)).otherwise(word)

    def ending(w: Column) -> Column:
        bare = F.when(w.endswith("ing"), cut(w, 3)).otherwise(cut(w, 2))
        again = F.when(bare.endswith("at") | bare.endswith("bl") | bare.endswith("iz") | bare.rlike(SHORT_STEM), F.concat(bare, F.lit("e"))).when(bare.rlike(DOUBLED), cut(bare, 1)).otherwise(bare)
        ends = w.endswith("ing") | (w.endswith("ed") & ~w.endswith("eed"))
        return F.when(w.endswith("eed"), F.when(cut(w, 3).rlike(HAS_MEASURE), cut(w, 1)).otherwise(w)).when(ends & bare.rlike(HAS_VOWEL), again).otherwise(w)

    def last(w: Column) -> Column:
        return F.when(w.endswith("y") & cut(w, 1).rlike(HAS_VOWEL), F.concat(cut(w, 1), F.lit("i"))).otherwise(w)

    return F.when(F.length(word) > 2, last(ending(plural))).otherwise(word)


def stem_word(word: str) -> str:
    """stem() of one word, for tasks that stem each distinct word once."""
    if len(word) < 3:
        return word
    w = word[:-2] if word.endswith(("sses", "ies")) else word[:-1] if word.endswith("s") and not word.endswith("ss") else word
    if w.endswith("eed"):
        w = w[:-1] if re.search(HAS_MEASURE, w[:-3]) else w
    elif w.endswith(("ing", "ed")):
        bare = w[:-3] if w.endswith("ing") else w[:-2]
        if re.search(HAS_VOWEL, bare):
            w = bare + "e" if bare.endswith(("at", "bl", "iz")) or re.search(SHORT_STEM, bare) else bare[:-1] if re.search(DOUBLED, bare) else bare
    return w[:-1] + "i" if w.endswith("y") and re.search(HAS_VOWEL, w[:-1]) else w


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def markdown_title(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, MARKDOWN_H1, 1), F.lit(""))


def stem_title(path: Column) -> Column:
    return F.translate(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), "-_", "  ")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def permalink(repo: Column, sha: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(repo, r"\.git$", ""), F.lit("/blob/"), sha, F.lit("/"), path)


def module_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))


def local_commit(path: Column) -> Column:
    return F.concat(F.lit("local-"), F.substring(F.sha1(path), 1, 32))


def citation_label(heading_path: Column, source_path: Column, version: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(heading_path, F.lit("")), source_path), F.lit(" ("), version, F.lit(")"))


def span_text(number: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), label, F.lit("\n"), text)


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, FENCED_CODE, " ")


def strip_code(text: Column) -> Column:
    return F.regexp_replace(strip_fences(text), INLINE_CODE, " ")


def citations(text: Column) -> Column:
    """Distinct citation numbers outside code, ascending."""
    groups = F.regexp_extract_all(strip_code(text), F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.cast("int"))))
    return F.array_sort(F.array_distinct(numbers))


def invalid_citations(cited: Column, n_spans: Column) -> Column:
    return F.filter(cited, lambda n: (n < 1) | (n > n_spans))


def uncited_spans(cited: Column, n_spans: Column) -> Column:
    every = F.when(n_spans > 0, F.sequence(F.lit(1), n_spans)).otherwise(F.array().cast("array<int>"))
    return F.array_except(every, cited)


def sentences(text: Column) -> Column:
    """Sentences of each line, without list and heading marks; dots of abbreviations and between digits end none."""
    safe = text
    for a in ABBREVIATIONS:
        safe = F.replace(safe, F.lit(a), F.lit(a.replace(".", DOT)))
    safe = F.regexp_replace(safe, r"(?<=\d)\.(?=\d)", DOT)
    lines = F.transform(F.split(safe, r"\r?\n"), lambda x: strip(F.regexp_replace(F.regexp_replace(x, LIST_MARKER, ""), HEADING_MARKER, "")))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_BOUNDARY)))
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(DOT), F.lit(".")))), lambda s: s != "")


def is_substantive(sentence: Column) -> Column:
    """At least four words of letters outside citations, and no short label before a colon."""
    n = F.regexp_count(F.regexp_replace(sentence, CITATION, " "), F.lit(CLAIM_WORD))
    return (n >= 4) & ~(F.rtrim(sentence).endswith(":") & (n <= 8))


def is_context_remark(sentence: Column) -> Column:
    return sentence.rlike(CONTEXT_REMARK) | sentence.rlike(FIRST_PERSON_LIMIT)


def flags_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CLI_FLAG), F.lit(0))))


def config_keys_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(BACKTICKED), F.lit(1)), lambda k: k.rlike(SNAKE_KEY))))


def flag_name(field: Column) -> Column:
    return F.concat(F.lit("--"), F.replace(field, F.lit("_"), F.lit("-")))


def issue_title(title: Column) -> Column:
    return strip(F.regexp_replace(title, ISSUE_PREFIX, ""))


def issue_question(body: Column) -> Column:
    """The question section of an issue body, else the body without its environment section; boilerplate is cut."""
    text = F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    after = lambda heading: F.regexp_replace(text, rf"(?s)\A.*?{_open(heading)}", "")
    environment = after(ENVIRONMENT_HEADING)
    following = F.regexp_extract(environment, r"(?ms)(^###\s+.*)\z", 1)
    text = F.when(text.rlike(QUESTION_HEADING), after(QUESTION_HEADING)).when(text.rlike(ENVIRONMENT_HEADING), F.coalesce(F.nullif(following, F.lit("")), environment)).otherwise(text)
    return strip(F.regexp_replace(text, rf"{BOILERPLATE_HEADING}(?s:.*)", ""))


def _open(pattern: str) -> str:
    return f"(?im:{pattern[5:]})"


def snippet(text: Column, size: int = 240) -> Column:
    return F.substring(strip(F.regexp_replace(text, r"\s+", " ")), 1, size)


def _places(x: Column, n: int) -> Column:
    """x with n decimals as C's printf rounds it, by the exact binary value; Java's formatter rounds the shortest decimal digits up instead. Null is -."""
    return F.when(x.isNull(), "-").otherwise(F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * n)))


def two_places(x: Column) -> Column:
    return _places(x, 2)


def four_places(x: Column) -> Column:
    return _places(x, 4)


def percent(x: Column) -> Column:
    return F.coalesce(F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit("-"))
