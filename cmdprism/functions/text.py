"""String expressions: normalisation, group keys, JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate command-line tokens (Unicode white
# space plus the four ASCII separators), spelled out because the JVM's \s is narrower.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same class for the JVM. Printable ASCII and the letters up to U+167F are ruled out by
# the first test, so that ordinary text never reaches the long list.
SPACE = rf"[[^!-~\xa1-\x{{167f}}]&&[{WHITESPACE}]]"
NON_SPACE = rf"[!-~\xa1-\x{{167f}}[^{WHITESPACE}]]"
# A white-space run that is not just one blank.
UNEVEN_SPACE = rf"(?: {SPACE}+|[[^ -~\xa1-\x{{167f}}]&&[{WHITESPACE}]]{SPACE}*)"

# Patterns and place-holders of the normalised command line. The patterns begin
# with a plain character test and look behind only after it, which keeps the search fast.
LONG_TOKEN = "[A-Za-z0-9+/=](?<![A-Za-z0-9+/=]{2})[A-Za-z0-9+/=]{15,}"
LONG_TOKEN_MARK = "<B64>"
NUMBER_MARK = "<NUM>"
WORD_CHAR = r"\p{L}\p{N}_"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space become one blank; outer blanks go."""
    return F.trim(F.regexp_replace(c, UNEVEN_SPACE, " "))


def strip(c: Column) -> Column:
    """Remove outer white space of any kind; the look-behind keeps long inner runs linear."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}(?<!{SPACE}{{2}}){SPACE}*\z", "")


def normalize_commandline(c: Column) -> Column:
    """Command line with literals masked, so that near-duplicates share one text.

    A run of 16 or more hex digits is always a LONG_TOKEN too, so no separate hex mark
    can ever appear.
    """
    flat = F.lower(collapse_whitespace(text_or_empty(c)))
    quoted = F.startswith(flat, F.lit('"'))
    unquoted = F.when(quoted, F.regexp_replace(flat, r'(?s)^"(?:(.*)")?\z', "$1")).otherwise(flat)
    masked = F.regexp_replace(unquoted, LONG_TOKEN, LONG_TOKEN_MARK)
    numbers = rf"\p{{Nd}}(?<![{WORD_CHAR}]\p{{Nd}})\p{{Nd}}*+(?![{WORD_CHAR}])"
    return F.trim(F.regexp_replace(masked, numbers, NUMBER_MARK))


def clean_command_text(c: Column) -> Column:
    """Lower-cased text with single blanks; literals are kept."""
    return F.lower(collapse_whitespace(text_or_empty(c)))


def basename(c: Column, windows_paths: bool = False) -> Column:
    """Last path component, lower-cased.

    Only ``/`` separates components unless ``windows_paths`` is set: identity keys made
    elsewhere keep the whole back-slash path, and those must still match.
    """
    path = text_or_empty(c)
    if windows_paths:
        path = F.translate(path, "\\", "/")
    trimmed = F.regexp_replace(path, r"(?:/+\.?)+\z", "")
    name = F.regexp_extract(trimmed, r"[^/]*\z", 0)
    return F.lower(F.when(name == ".", "").otherwise(name))


def never_null(c: Column) -> Column:
    """Mark an expression that never gives NULL, so that joins on it add no filter that computes it again."""
    return F.coalesce(c, F.lit(""))


def group_key(image: Column, command: Column, windows_paths: bool = False) -> Column:
    key = F.concat(basename(image, windows_paths), F.lit("::"), normalize_commandline(command))
    return never_null(key)


def group_digest(key: Column, seed: int = 13) -> Column:
    """A fixed-width, seed-dependent stand-in for a group key of any length."""
    return never_null(F.sha2(F.concat(key, F.lit(f"|{seed}")), 256))


def json_string(c: Column) -> Column:
    """JSON text of a string: quotes, back-slashes and control characters escaped, the rest kept."""
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    escaped = quoted
    for code in range(0x20):
        char = chr(code)
        escaped = F.replace(escaped, F.lit(char), F.lit(short.get(char, f"\\u{code:04x}")))
    body = F.when(quoted.rlike(r"[\x00-\x1f]"), escaped).otherwise(quoted)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def json_object(fields: dict[str, Column], skip_null: bool = False) -> Column:
    """JSON object text with ``", "`` and ``": "`` separators from already rendered values."""
    parts = [F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items()]
    if skip_null:
        inner = F.array_join(F.array_compact(F.array(*parts)), ", ")
    else:
        inner = F.concat_ws(", ", *parts)
    return F.concat(F.lit("{"), inner, F.lit("}"))


def row_hash(command: Column, image: Column, prompt: Column) -> Column:
    """SHA-256 of the sorted-key JSON of the three identifying fields."""
    payload = json_object(
        {
            "CommandLine": json_string(command),
            "SourceImage": json_string(image),
            "prompt": json_string(prompt),
        }
    )
    return F.sha2(payload, 256)


def is_valid_text(c: Column) -> Column:
    """Present and not blank."""
    return c.isNotNull() & c.rlike(NON_SPACE)


def or_unknown(*choices: Column) -> Column:
    """First non-empty choice, else ``unknown``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit("unknown"))


def parse_object(text: Column, schema: str) -> Column:
    """STRUCT read from a text that is exactly one JSON object, else NULL.

    The text is parsed as the first item of an array that must also end properly: anything
    after the object then shows up as a parse failure or as a wrong item count. The lambda
    makes sure that the parser runs once per text.
    """
    items = F.from_json(F.concat(F.lit("["), text, F.lit(",null]")), f"ARRAY<STRUCT<{schema}>>")
    only = F.transform(F.array(items), lambda a: F.when(F.size(a) == 2, a[0]))[0]
    return F.when(text.startswith("{"), only)
