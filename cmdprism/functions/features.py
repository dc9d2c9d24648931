"""The 25 command-line features as one code-generated projection."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.functions.text import NON_SPACE, SPACE, text_or_empty
from cmdprism.session import COMMAND, IMAGE

# Feature names with the lower-cased texts that set them. A flag is 1 when
# the command holds any of its texts, in any letter case.
KEYWORD_TEXTS: dict[str, tuple[str, ...]] = {
    "has_powershell": ("powershell",),
    "has_encodedcommand": ("-enc",),
    "has_download": ("download", "http", "ftp"),
    "has_iwr": ("invoke-webrequest", "iwr"),
    "has_curl": ("curl",),
    "has_certutil": ("certutil",),
    "has_bitsadmin": ("bitsadmin",),
    "has_wmic": ("wmic",),
    "has_rundll32": ("rundll32",),
    "has_schtasks": ("schtasks",),
    "has_mshta": ("mshta",),
    "has_cmd": ("cmd.exe", "cmd /c"),
    "has_bypass": ("bypass",),
}
# The flags that need a pattern, over the command as written or lower-cased.
BASE64_PATTERN = "[A-Za-z0-9+/=]{40,}"
REG_ADD_PATTERN = rf"reg(\.exe)?{SPACE}+add"
SCRIPT_EXTENSION_PATTERN = rf"""\.(cab|zip|ps1|bat|vbs)'*"*({SPACE}|\z)"""

# Every character that separates tokens, the same ones as in WHITESPACE.
WHITESPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Column order of the feature table.
COUNT_FEATURES = ["cmd_length", "cmd_token_count", "num_special_chars", "cmd_upper_ratio", "cmd_digit_count"]
FLAG_FEATURES = [
    "has_pipe", "has_powershell", "has_encodedcommand", "has_base64", "has_download", "has_iwr",
    "has_curl", "has_certutil", "has_bitsadmin", "has_wmic", "has_rundll32", "has_reg_add",
    "has_schtasks", "has_mshta", "has_cmd", "has_bypass", "has_suspicious_ext",
]
CATEGORICAL_FEATURES = ["source_image_base", "cmd_exe_base"]
FEATURES = COUNT_FEATURES + FLAG_FEATURES + CATEGORICAL_FEATURES + ["image_path_depth"]
NUMERIC_FEATURES = [name for name in FEATURES if name not in CATEGORICAL_FEATURES]


@cache
def digit_class() -> str:
    """Non-ASCII characters that count as digits: decimal digits plus super-, subscript and circled ones."""
    extra = (chr(c) for c in range(0x80, sys.maxunicode + 1))
    return r"\p{Nd}" + "".join(c for c in extra if c.isdigit() and unicodedata.category(c) != "Nd")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold_case(c: Column) -> Column:
    """Lower case, with the four non-ASCII letters that match ASCII ones folded as well."""
    folded = c
    for letter, plain in (("\u017f", "s"), ("\u212a", "k"), ("\u0131", "i"), ("\u0130", "i")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.lower(F.when(is_ascii(c), c).otherwise(folded))


def _count_removed(c: Column, kept: Column) -> Column:
    return (F.length(c) - F.length(kept)).cast("bigint")


def _flag(c: Column) -> Column:
    return c.cast("double")


def _kept(c: Column, kept_class: str) -> Column:
    """Number of characters of a class: the other ones go in whole runs."""
    return F.length(F.regexp_replace(c, f"[^{kept_class}]+", "")).cast("bigint")


def _digits(c: Column) -> Column:
    foreign = F.regexp_replace(c, r"[\x00-\x7f]+", "")
    return _kept(c, "0-9") + F.when(is_ascii(c), F.lit(0).cast("bigint")).otherwise(_kept(foreign, digit_class()))


def _tokens(c: Column) -> Column:
    """Number of white-space separated tokens, without a pattern: white space becomes blanks, and each run of blanks a pair of marks,
    which are white space themselves and so in no text by then."""
    blank = F.trim(F.translate(c, WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS)))
    marked = F.replace(F.replace(blank, F.lit(" "), F.lit("\x1e\x1f")), F.lit("\x1f\x1e"), F.lit(""))
    runs = F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("\x1e"), F.lit("")))
    return F.when(blank == "", 0).otherwise(runs + 1).cast("bigint")


def feature_columns(cmd: Column, folded: Column, image: Column) -> dict[str, Column]:
    """Feature expressions over non-null command, case-folded command and image path."""
    letters, upper = _kept(cmd, r"\p{L}"), _kept(cmd, r"\p{Lu}")
    out = {
        "cmd_length": F.length(cmd).cast("bigint"),
        "cmd_token_count": _tokens(cmd),
        "num_special_chars": _count_removed(cmd, F.translate(cmd, "|&;", "")),
        "cmd_upper_ratio": F.when(letters > 0, upper / letters).otherwise(0.0),
        "cmd_digit_count": _digits(cmd),
        "has_pipe": _flag(cmd.contains("|") | cmd.contains("&&")),
        "has_base64": _flag(cmd.rlike(BASE64_PATTERN)),
        "has_reg_add": _flag(folded.rlike(REG_ADD_PATTERN)),
        "has_suspicious_ext": _flag(F.lower(cmd).rlike(SCRIPT_EXTENSION_PATTERN)),
        "source_image_base": F.lower(F.substring_index(image, "\\", -1)),
        "cmd_exe_base": F.lower(F.regexp_extract(cmd, f"{NON_SPACE}+", 0)),
        "image_path_depth": _count_removed(image, F.replace(image, F.lit("\\"), F.lit(""))),
    }
    for name, texts in KEYWORD_TEXTS.items():
        hit = folded.contains(texts[0])
        for text in texts[1:]:
            hit = hit | folded.contains(text)
        out[name] = _flag(hit)
    return {name: out[name] for name in FEATURES}


def build_features(df: DataFrame, command: str = COMMAND, image: str = IMAGE) -> DataFrame:
    """Append all features. Missing command or image counts as empty text."""
    cmd, folded, src = F.col("_cmd"), F.col("_folded"), F.col("_src")
    staged = df.withColumns({"_cmd": text_or_empty(F.col(command)), "_src": text_or_empty(F.col(image))})
    staged = staged.withColumn("_folded", fold_case(cmd))
    return staged.withColumns(feature_columns(cmd, folded, src)).drop("_cmd", "_folded", "_src")


def align_features(df: DataFrame, feature_list: list[str], categoricals: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the listed features in order; absent or unreadable ones get a neutral value."""
    present = set(df.columns)
    out = []
    for name in feature_list:
        if name in categoricals:
            value = F.coalesce(F.col(name).cast("string"), F.lit("unknown")) if name in present else F.lit("unknown")
        elif name in present:
            number = F.col(name).try_cast("double")
            value = F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))
        else:
            value = F.lit(0.0)
        out.append(value.alias(name))
    return df.select(*keep, *out)
