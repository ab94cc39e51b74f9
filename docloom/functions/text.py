"""Text columns: stripping, tokens, cleaning, placeholders, previews, keys and labels. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any kind (Unicode's) at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def tokens(c: str | Column) -> Column:
    """Lower-cased parts between white space, none empty."""
    return F.filter(F.split(F.lower(col(c)), r"(?U)\s+"), lambda x: x != "")


# Language codes and their names: fixed values.
LANGUAGES = {
    "vi": "Vietnamese (Tiếng Việt)",
    "en": "English",
    "ja": "Japanese (日本語)",
    "zh-cn": "Simplified Chinese (简体中文)",
    "zh-tw": "Traditional Chinese (繁體中文)",
    "auto": "automatically detected language",
}


def language_name(code: str | Column) -> Column:
    """The display name; an unknown code passes through."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(names, col(code)), col(code))


def clean_translation(c: str | Column, target: str | Column = "vi", strip_markdown: bool = False) -> Column:
    """Strips; for Vietnamese also puts spaces around punctuation in order.

    No space before . , ; : ! ?; one after , ; : before a letter and after . ! ? before A-Z, so that numbers, times,
    addresses and decimals stay; runs of spaces become one. strip_markdown drops ** and * first.
    """
    target = F.lit(target) if isinstance(target, str) else target
    text = strip(c)
    own = F.replace(F.replace(col(c), F.lit("**"), F.lit("")), F.lit("*"), F.lit("")) if strip_markdown else col(c)
    vi = F.regexp_replace(strip(own), r"(?U)\s+([.,;:!?])", "$1")
    vi = F.regexp_replace(vi, r"([,;:])(?=\p{L})", "$1 ")
    vi = F.regexp_replace(vi, r"([.!?])(?=[A-Z])", "$1 ")
    return F.when(target == "vi", F.regexp_replace(vi, " {2,}", " ")).otherwise(text)


def preview(c: str | Column, size: int = 80, ellipsis: bool = False) -> Column:
    """One line of at most size characters; with ellipsis a cut text ends in one."""
    text = strip(F.replace(col(c), F.lit("\n"), F.lit(" ")))
    cut = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(cut, F.lit("…"))).otherwise(cut) if ellipsis else cut


#: (written form, pattern around the number) of formula placeholders.
PLACEHOLDERS = {"braces": ("{v", "}", r"\{\s*v\s*", r"\s*\}"), "brackets": ("⟦", "⟧", r"⟦\s*", r"\s*⟧")}


def protect(c: str | Column, formula: str = r"\$[^$]+\$", style: str = "braces") -> tuple[Column, Column]:
    """(text with the i-th formula as placeholder i, array of the formulas); formula is a Java pattern without groups."""
    left, right, _, _ = PLACEHOLDERS[style]
    found = F.regexp_extract_all(col(c), F.lit(f"({formula})"), F.lit(1))
    parts = F.split(col(c), formula, -1)
    text = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1),
        lambda acc, i: F.when(i < 1, acc).otherwise(F.concat(acc, F.lit(left), i.cast("string"), F.lit(right), F.get(parts, i))),
    )
    return F.when(F.size(found) > 0, text).otherwise(col(c)), found


def restore(c: str | Column, formulas: str | Column, style: str = "braces") -> Column:
    """Puts formula i, as it stands, wherever placeholder i is, whatever its case and inner blanks."""
    _, _, before, after = PLACEHOLDERS[style]
    formulas = col(formulas)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(formulas), F.lit(1))), col(c),
        lambda acc, i: F.when(i > F.size(formulas), acc).otherwise(
            F.regexp_replace(acc, F.concat(F.lit(f"(?i){before}"), i.cast("string"), F.lit(after)), F.regexp_replace(F.get(formulas, i - 1), F.lit(r"([\\$])"), F.lit(r"\\$1")))
        ),
    )


def rich_text(tag: Column | int | str, inner: str | Column) -> Column:
    tag = tag if isinstance(tag, Column) else F.lit(str(tag))
    return F.concat(F.lit("<b"), tag, F.lit(">"), col(inner), F.lit("</b"), tag, F.lit(">"))


def content_hash(c: str | Column) -> Column:
    """SHA-256 in hex of a text's UTF-8 or of bytes."""
    return F.sha2(col(c), 256)


def memory_key(lang_in, lang_out, service, model, text) -> Column:
    """Key of the translation memory; a null model is the empty one."""
    return F.sha2(F.concat_ws("|", col(lang_in), col(lang_out), col(service), F.coalesce(col(model), F.lit("")), col(text)), 256)


def document_key(file_hash, lang_out, service, model, version) -> Column:
    """Key of the document cache; the source language is left out on purpose."""
    return F.sha2(F.concat_ws("|", col(file_hash), col(lang_out), col(service), F.coalesce(col(model), F.lit("")), col(version)), 256)


def eta_label(seconds: str | Column) -> Column:
    s = col(seconds)
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    minutes = F.floor(s / 60)
    rest = half_up(s - minutes * 60)
    long = F.when(rest == 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
    return F.when(s.isNull() | F.isnan(s.cast("double")) | (s < 0) | (s == float("inf")), "—").when(s < 1, "<1s").when(s < 60, F.concat(half_up(s).cast("string"), F.lit("s"))).otherwise(long)


def relative_label(age_seconds: str | Column) -> Column:
    """``3 minutes ago``, ``in 2 hours``, ``yesterday``, ``now``; a null age is ``earlier``."""
    diff = F.floor(-col(age_seconds) + 0.5).cast("long")
    size = F.abs(diff)
    unit = lambda per: F.floor(diff / F.lit(float(per)) + 0.5).cast("long")

    def say(n: Column, word: str, near: dict[int, str]) -> Column:
        many = F.concat(F.abs(n).cast("string"), F.lit(f" {word}"), F.when(F.abs(n) == 1, "").otherwise("s"))
        out = F.when(n < 0, F.concat(many, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), many))
        for k, name in near.items():
            out = F.when(n == k, name).otherwise(out)
        return out

    return (
        F.when(diff.isNull(), "earlier").when(size < 60, say(diff, "second", {0: "now"})).when(size < 3600, say(unit(60), "minute", {0: "this minute"}))
        .when(size < 86400, say(unit(3600), "hour", {0: "this hour"})).otherwise(say(unit(86400), "day", {-1: "yesterday", 0: "today", 1: "tomorrow"}))
    )


def eta_left(anchor: str | Column, since: str | Column) -> Column:
    """What is left of an estimate some seconds after it was made; null without one."""
    return F.greatest(F.lit(0.0), col(anchor) - col(since))
