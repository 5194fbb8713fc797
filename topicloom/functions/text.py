"""Text functions: Column in, Column out, all on the JVM side."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as V

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(text, F.lit(V.WHITESPACE))


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return strip(F.regexp_replace(text, f"[{V.WHITESPACE_CLASS}]+", " "))


def clean_corpus(text: Column) -> Column:
    """Sentence corpus cleaner: punctuation to blanks, bracket to full stop, phrases deleted."""
    # One translate() does all single-character replacements in one pass.
    source = V.CORPUS_PUNCTUATION + V.CORPUS_FULL_STOP
    target = " " * len(V.CORPUS_PUNCTUATION) + "." * len(V.CORPUS_FULL_STOP)
    text = squeeze(F.translate(text, source, target))
    for phrase in V.CORPUS_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return text


def clean_record(text: Column, keep: str = V.RECORD_KEEP) -> Column:
    """Nested record cleaner: everything outside ``keep`` becomes one blank between words.

    ``keep`` is the body of a regex class, so ranges such as ``a-z`` can be added.
    Taking out the kept runs is several times faster than replacing the others.
    """
    return F.array_join(F.regexp_extract_all(text, F.lit(f"[{keep}]+"), F.lit(0)), " ")


def substitute_chars(text: Column, mapping: Mapping[str, str]) -> Column:
    """Replace single characters by single characters."""
    if any(len(k) != 1 or len(v) != 1 for k, v in mapping.items()):
        raise ValueError("the mapping must go from one character to one character")
    return F.translate(text, "".join(mapping), "".join(mapping.values()))


def clean_sentence(text: Column, mapping: Mapping[str, str] | None = None, keep: str = V.RECORD_KEEP) -> Column:
    """To string, substitute characters, then the record cleaner."""
    text = text.cast("string")
    if mapping:
        text = substitute_chars(text, mapping)
    return clean_record(text, keep)


def split_sentences(text: Column) -> Column:
    """Pieces between full stops, trimmed, each with its full stop back.

    Text that ends in a full stop has an empty last piece, which becomes ``"."``.
    """
    return F.transform(F.split(text, r"\."), lambda s: F.concat(strip(s), F.lit(".")))


def corpus_sentences(text: Column, *tags: Column, longer_than: int = V.CORPUS_LONGER_THAN) -> Column:
    """Array of ``(*tags, pos, raw)`` pieces longer than the bound; the bound applies before cleaning."""
    pieces = F.transform(F.split(text, V.CORPUS_SENTENCE_ENDS), lambda s, i: F.struct(i.alias("pos"), s.alias("raw")))
    kept = F.filter(pieces, lambda p: F.length(p["raw"]) > longer_than)
    return F.transform(kept, lambda p: F.struct(*tags, p["pos"].alias("pos"), p["raw"].alias("raw")))


def first_section(text: Column, rules: Iterable[tuple[str, str, int]]) -> Column:
    """First group of the first rule that matches, or null.

    A rule is ``(pattern, suffix, cut)``: ``suffix`` is put back behind the match,
    ``cut`` characters are taken off its end.  ``(?d)`` keeps ``.`` from stopping
    at anything but a line feed.
    """
    choices = []
    for pattern, suffix, cut in rules:
        found = _group(text, pattern, fixed_part(pattern))
        if suffix:
            found = F.transform(found, lambda s: F.concat(s, F.lit(suffix)))
        if cut:
            found = F.transform(found, lambda s: F.substring(s, F.lit(1), F.greatest(F.length(s) - cut, F.lit(0))))
        choices.append(F.get(found, F.lit(0)))
    return strip(F.coalesce(*choices))


def fixed_part(pattern: str) -> str:
    """Longest plain text that every match of the pattern holds; empty if there is none to be sure of."""
    if "|" in pattern:
        return ""
    plain = re.sub(r"\\.|\[[^\]]*\][*+?]*|\([^()]*\)[*+?]*|.[*?{]", "\0", pattern)
    return max(re.split(r"[\0.^$+{}()\[\]*?]", plain), key=len)


def _group(text: Column, pattern: str, needed: str = "") -> Column:
    """First group of the pattern as an array of one entry, or of none.

    The array lets later steps name the match without searching for it again.
    A text without ``needed`` is not searched at all.
    """
    found = F.regexp_extract(text, "(?d)" + pattern, 1)
    if needed:
        found = F.when(F.contains(text, F.lit(needed)), found).otherwise(F.lit(""))
    return F.filter(F.array(found), lambda s: s != "")


def joined_sections(text: Column, patterns: Sequence[str] = V.CORPUS_SECTIONS) -> Column:
    """Matches of all patterns in a row; a missing part is skipped, none at all gives null."""
    found = F.array_join(F.concat(*[_group(text, p) for p in patterns]), "")
    return F.get(F.filter(F.array(found), lambda s: s != ""), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def drop_words(words: Column, stopwords: Sequence[str]) -> Column:
    """Array without the stopwords; duplicates of other words stay."""
    if not stopwords:
        return words
    return F.filter(words, lambda t: ~t.isin(*stopwords))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low``..``high`` neighbouring words, joined by blanks."""
    runs = [words if n == 1 else _runs(words, n) for n in range(low, high + 1)]
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def _runs(words: Column, n: int) -> Column:
    # sequence(1, 0) would count down, so short arrays get no start at all.
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def trailing_year(reference: Column) -> Column:
    """Year in the last four characters, null when they are no number."""
    return F.right(reference, F.lit(4)).try_cast("int")


def extend_link(link: Column, host: str, old: str = "HTML", new: str = "XML") -> Column:
    """Absolute address of the other representation of a record."""
    return F.concat(F.lit(host), F.replace(link, F.lit(old), F.lit(new)))


def join_keywords(words: Column) -> Column:
    return F.array_join(words, ", ")


def keywords_text(joined: Column) -> Column:
    """Keyword list back to plain words for the encoder."""
    return F.replace(joined, F.lit(", "), F.lit(" "))
