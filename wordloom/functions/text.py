"""Column functions on strings, with the reference rules for white space, globs, hashes and names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, line ends and the byte order mark.
SPACE = r"[\s\x{FEFF}\p{Z}]"
LOCALE = r"\A[a-z]{2,3}(-[0-9A-Za-z]{2,8})*\z"
LANGUAGES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "pt-BR": "Brazilian Portuguese", "nl": "Dutch", "ja": "Japanese",
    "ko": "Korean", "zh": "Chinese", "zh-CN": "Simplified Chinese", "zh-TW": "Traditional Chinese", "ru": "Russian", "ar": "Arabic", "hi": "Hindi", "tr": "Turkish", "pl": "Polish",
    "sv": "Swedish", "da": "Danish", "no": "Norwegian", "fi": "Finnish", "cs": "Czech", "el": "Greek", "he": "Hebrew", "th": "Thai", "vi": "Vietnamese", "id": "Indonesian",
    "uk": "Ukrainian", "ro": "Romanian", "hu": "Hungarian", "bg": "Bulgarian", "hr": "Croatian", "sk": "Slovak",
}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(x: str | Column) -> Column:
    """Nothing but white space."""
    return col(x).rlike(rf"\A{SPACE}*\z")


def plural_forms(x: str | Column) -> Column:
    return F.size(F.split(col(x), r"\|", -1))


def has_pipe_plural(x: str | Column) -> Column:
    """Several forms and a brace placeholder: prose with a bar in it is no plural."""
    return (plural_forms(x) > 1) & col(x).rlike(r"\{[^}]+\}")


def looks_translatable(x: str | Column) -> Column:
    """White space between other characters, and an ASCII letter."""
    return col(x).rlike(rf"(?s)[^\s\x{{FEFF}}\p{{Z}}]{SPACE}+[^\s\x{{FEFF}}\p{{Z}}]") & col(x).rlike("[A-Za-z]")


def short_hash(x: str | Column, length: int = 16) -> Column:
    """The first hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(col(x).cast("binary"), 256), 1, length)


def lock_id(lang: str | Column, ns: str | Column, path: str | Column) -> Column:
    return F.concat_ws("::", col(lang), col(ns), col(path))


def quoted(x: str | Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.array(col(x))), r"\A\[|\]\z", "")


def pair_hash(source, translation, source_lang, lang, model=None, glossary=None) -> Column:
    """32 digits over what a verdict depends on. Without a model it is "default"; without a glossary, JSON's null."""
    parts = [col(source), col(translation), col(source_lang), col(lang), F.coalesce(col(model), F.lit("default")) if model is not None else F.lit("default")]
    inner = [F.regexp_replace(F.to_json(F.array(p)), r"\A\[|\]\z", "") for p in parts]
    last = F.coalesce(col(glossary), F.lit("null")) if glossary is not None else F.lit("null")
    return short_hash(F.concat(F.lit("["), F.concat_ws(",", *inner, last), F.lit("]")), 32)


def content_key(content: str | Column, targets: list[str]) -> Column:
    """What a finished translation of a file is kept under: MD5 of its text and the languages asked for."""
    return F.md5(F.concat(col(content), F.lit(",".join(targets))))


def is_substantive(source: str | Column, translation: str | Column) -> Column:
    """Four words or more, and not the same in both."""
    return (F.size(F.split(col(source), r"\s+")) >= 4) & (col(source) != col(translation))


def language_name(code: str | Column) -> Column:
    """Its English name, or that of what stands before the hyphen, or the code."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    c = col(code)
    return F.coalesce(F.try_element_at(names, c), F.try_element_at(names, F.substring_index(c, "-", 1)), c)


def base_language(code: str | Column) -> Column:
    return F.substring_index(col(code), "-", 1)


def xml_escape(x: str | Column) -> Column:
    out = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def relative(path: str | Column, root: str | Column) -> Column:
    """A path below ``root`` without it, with ``/`` between its parts; others as they are."""
    one = lambda x: F.replace(x, F.lit("\\"), F.lit("/"))
    p, r = one(col(path)), F.concat(F.rtrim(one(col(root) if isinstance(root, Column) else F.lit(root)), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(p, r), F.substr(p, F.length(r) + 1)).otherwise(p)


def split_list(text: str | None) -> list[str]:
    """What lies between commas, trimmed, without empty parts."""
    return [p for p in (x.strip() for x in (text or "").split(",")) if p]


def ignore_regex(globs: Iterable[str] | str | None) -> str | None:
    """One expression for ignore globs: ``*`` is anything but a line end, dots included; everything else is itself."""
    held = split_list(globs) if isinstance(globs, str) else list(globs or ())
    each = ["".join("[^\\n\\r\\x{2028}\\x{2029}]*" if c == "*" else quote(c) for c in g) for g in held]
    return rf"\A(?:{'|'.join(each)})\z" if each else None


def is_ignored(globs: Iterable[str] | str | None, ns: str | Column = "ns", path: str | Column = "path") -> Column:
    """A glob matches the path, or the namespace, a colon and the path."""
    pattern = ignore_regex(globs)
    if pattern is None:
        return F.lit(False)
    return F.coalesce(col(path).rlike(pattern) | F.concat(col(ns), F.lit(":"), col(path)).rlike(pattern), F.lit(False))


def skip_regex(globs: Iterable[str]) -> str | None:
    """One expression for skip globs: ``*`` is one segment of a path, ``**`` any number."""
    each = []
    for g in globs:
        parts = re.split(r"(\*\*|\*)", g)
        each.append("".join(".*" if p == "**" else r"[^.]*" if p == "*" else "".join(map(quote, p)) for p in parts))
    return rf"(?s)\A(?:{'|'.join(each)})\z" if each else None


def quote(c: str) -> str:
    return c if c.isalnum() or c == "_" else "\\" + c if ord(c) < 128 else f"\\x{{{ord(c):X}}}"
