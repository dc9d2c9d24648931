"""Human-readable signals and feature phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdprism.functions.numbers import fixed

# Flag features with their description, in report order.
FLAG_TEXTS = {
    "has_powershell": "Invokes PowerShell",
    "has_encodedcommand": "Uses EncodedCommand obfuscation",
    "has_base64": "Contains long base64-like blobs",
    "has_download": "Contacts remote resources (download/iwr/curl)",
    "has_iwr": "Uses Invoke-WebRequest",
    "has_curl": "Uses curl for network access",
    "has_certutil": "Abuses certutil (common LotL)",
    "has_bitsadmin": "Bitsadmin file transfer detected",
    "has_wmic": "WMIC remote execution used",
    "has_rundll32": "Runs rundll32 (possible LOLBin abuse)",
    "has_reg_add": "Touches registry via reg add",
    "has_schtasks": "Creates or modifies scheduled tasks",
    "has_mshta": "MSHTA execution observed",
    "has_cmd": "Explicit cmd.exe chaining",
    "has_bypass": "ExecutionPolicy/AMSI bypass keyword",
    "has_pipe": "Chains commands via pipes/AND",
    "has_suspicious_ext": "Touches suspicious archive/script extensions",
}
# Fixed values: (feature, threshold, text before and after the value, decimals, phrase), in report order.
NUMERIC_SIGNALS = [
    ("cmd_length", 200, "Very long command (~", " chars)", 0, "Long command strings"),
    ("cmd_token_count", 25, "Large number of command tokens (", ")", 0, "Many chained arguments"),
    ("cmd_digit_count", 25, "Contains many digits (", ")", 0, "Numerical obfuscation"),
    ("cmd_upper_ratio", 0.4, "High uppercase ratio (", ")", 2, "Uppercase-heavy obfuscation"),
    ("num_special_chars", 4, "Multiple chaining characters/pipes (", ")", 0, "Frequent piping/chaining"),
    ("image_path_depth", 6, "Executable buried deep in filesystem (depth ", ")", 0, "Deeply nested executable path"),
]
# Phrases of the categorical features.
CATEGORY_PHRASES = {"source_image_base": "Source executable", "cmd_exe_base": "Command entry point"}


def build_signals(available: Sequence[str] | None = None) -> Column:
    """Array of the signals that apply; features that are missing or NULL give none."""
    present = (lambda name: True) if available is None else set(available).__contains__
    parts = [F.when(F.col(n) >= 0.5, F.lit(text)) for n, text in FLAG_TEXTS.items() if present(n)]
    for name, threshold, before, after, digits, _ in NUMERIC_SIGNALS:
        if present(name):
            value = F.col(name).cast("double")
            text = F.concat(F.lit(before), fixed(value, digits), F.lit(after))
            parts.append(F.when((value >= threshold) & ~F.isnan(value), text))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def feature_phrase(name: Column) -> Column:
    """Phrase of a feature name; one-hot names carry their value."""
    known = {**FLAG_TEXTS, **{s[0]: s[5] for s in NUMERIC_SIGNALS}, **CATEGORY_PHRASES}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    out = F.try_element_at(table, name)
    hot = None
    for feature, phrase in CATEGORY_PHRASES.items():
        prefix = f"{feature}_"
        text = F.concat(F.lit(f"{phrase} is "), F.substr(name, F.lit(len(prefix) + 1)))
        hot = F.when(name.startswith(prefix), text) if hot is None else hot.when(name.startswith(prefix), text)
    return F.coalesce(out, hot.otherwise(name))
