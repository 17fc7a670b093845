"""Text columns: blank test, words, decoding and markup removal."""

from functools import reduce

from pyspark.sql import Column, functions as F

# Characters that count as white space at the end of a word.
WORD_SPACE = " \t\n\r\f\x0b"

# Elements that end a line of text.
BLOCK_TAGS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|"
    "li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)

# Character references, the ampersand last so that nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&euro;", "€"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
]


def has_text(text: Column) -> Column:
    """True when any character is not (Unicode) white space; false for null."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"), F.lit(False))


def words(text: Column) -> Column:
    """Words with the white space that follows each, so joined words give back the text."""
    return F.regexp_extract_all(text, F.lit(r"(\S+\s*)"), F.lit(1))


def bare_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def role_line(role: Column, text: Column) -> Column:
    return F.concat(F.initcap(role), F.lit(": "), F.coalesce(text, F.lit("")))


def strict_utf8(content: Column) -> Column:
    """Decoded text, or null when the bytes are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\uFEFF", "")


def decode_text(content: Column, extension: Column, latin_extensions=("txt", "log", "md", "csv")) -> Column:
    """UTF-8 first, then Latin-1 for plain-text extensions, otherwise null."""
    return F.coalesce(
        without_bom(strict_utf8(content)),
        F.when(extension.isin(*latin_extensions), F.decode(content, "ISO-8859-1")),
    )


def _replace(text: Column, *steps) -> Column:
    return reduce(lambda value, step: F.regexp_replace(value, *step), steps, text)


def _numbered_character(piece: Column) -> Column:
    """What follows `&#`, its number replaced by the character; anything else is put back as it was."""
    number = F.regexp_extract(piece, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
    code = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(
        F.nullif(number, F.lit(""))).cast("bigint")
    code = F.when(code == 160, 32).otherwise(code)
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(valid, F.concat(character, F.substr(piece, F.length(number) + 2))).otherwise(F.concat(F.lit("&#"), piece))


def _unescape(text: Column) -> Column:
    numbered = F.array_join(F.transform(
        F.split(text, "&#"), lambda piece, i: F.when(i == 0, piece).otherwise(_numbered_character(piece))), "")
    return reduce(lambda value, pair: F.replace(value, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, numbered)


def _drop_markup(html: Column) -> Column:
    return _replace(
        html,
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<script\b.*?</script\s*>", ""),
        (r"(?is)<style\b.*?</style\s*>", ""),
        (r"(?is)<head\b.*?</head\s*>", ""),
    )


def _tidy_lines(text: Column) -> Column:
    return F.trim(_replace(text, (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n")), F.lit(" \n"))


def html_to_text(html: Column) -> Column:
    """Visible text of a page, one line per block element."""
    body = _replace(
        _drop_markup(html), (r"\n", " "), (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n"), (r"<[^>]*>", ""))
    return _tidy_lines(_unescape(body))


def html_to_markdown(html: Column) -> Column:
    """As `html_to_text`, with headings marked by `#` and list items by `-`."""
    body = _replace(_drop_markup(html), (r"\n", " "))
    for level in range(1, 7):
        body = F.regexp_replace(body, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    body = _replace(
        body, (r"(?i)<li\b[^>]*>", "\n- "), (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n"), (r"<[^>]*>", ""))
    return _tidy_lines(_unescape(body))
