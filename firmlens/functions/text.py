"""Text expressions: markup removal, cleaning, file-name keys."""

from __future__ import annotations

import html as html_lib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their plain forms, same length.
PLAIN_FROM = "“”„‟‘’‚‛´`‐‑‒–—−   "
PLAIN_TO = "\"\"\"\"''''''------   "
# Ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
INVISIBLE = r"[\x{200B}\x{200C}\x{2060}\x{FEFF}\x{00AD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]"
NAME_KEY = r"^(.*)[_-](\d{4})(?:_([A-Za-z]+))?(?:\.\w+)?$"


def _mapped(text: Column, change) -> Column:
    """``change`` of every text but null ones; a worker holds a hundred texts at a time."""
    @F.udf("string", useArrow=False)
    def of(value: str | None) -> str | None:
        return None if value is None else change(value)

    return of(text)


def decoded(text: Column) -> Column:
    """Character references (all standard names, decimal, hexadecimal) as their characters, in one pass."""
    return _mapped(text, html_lib.unescape)


def _table_of_bytes() -> dict[str, int]:
    """Which byte from 0x80 on a character stands for in the two western one-byte tables."""
    out = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return out


_BYTE = _table_of_bytes()
_tail = "[" + "".join(re.escape(c) for c, b in _BYTE.items() if b < 0xC0) + "]"
_MISREAD = re.compile(f"[\u00c2-\u00df]{_tail}|[\u00e0-\u00ef]{_tail}{{2}}|[\u00f0-\u00f4]{_tail}{{3}}")
# Marks that may follow the last letter of a word in capitals.
_CLOSING = "…”’»“›—–™®°"


def _reread(m: re.Match) -> str:
    """The character that the bytes of a suspect run stand for in UTF-8, if it is the likelier reading."""
    run, text = m[0], m.string
    try:
        char = bytes(_BYTE[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return run
    before = text[m.start() - 1 : m.start()]
    if len(run) == 2:
        if (before.isupper() and run[1] in _CLOSING) or char < "\u00a0":
            return run
        # a letter beyond the western ones needs a neighbour that speaks for it
        if run[0] > "Ã" and not (before.islower() or _MISREAD.match(text, m.end()) or (m.start() > 1 and _MISREAD.match(text, m.start() - 2))):
            return run
    return char if char.isprintable() or char == "\u00a0" else run


def repair(text: str) -> str:
    """Text whose UTF-8 was read in a western one-byte table, read again (also if that happened twice); composed canonically."""
    while not text.isascii():
        again = unicodedata.normalize("NFC", _MISREAD.sub(_reread, text))
        if again == text:
            break
        text = again
    return text


def repaired(text: Column) -> Column:
    return _mapped(text, repair)


def html_text(html: Column) -> Column:
    """Visible text of a page: no script, style, comment or tag; character references decoded, spaces folded."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded(out), r"[\s\x{00A0}]+", " "))


def clean_text(text: Column) -> Column:
    """Misread characters repaired, plain typography, no emoji or invisible characters, single spaces, at most one blank line."""
    out = F.regexp_replace(repaired(text), r"\r\n?", "\n")
    out = F.translate(out, PLAIN_FROM, PLAIN_TO)
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    out = F.regexp_replace(F.regexp_replace(out, INVISIBLE, ""), EMOJI, "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def pieces(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def name_key(file_name: Column) -> dict[str, Column]:
    """Company, year and report type from '{company}_{year}[_{type}][.ext]' or with a dash before the year; nulls when the name does not fit."""
    part = lambda i: F.nullif(F.regexp_extract(file_name, NAME_KEY, i), F.lit(""))
    return {"company_id": part(1), "year": part(2).try_cast("int"), "report_type": part(3)}
