"""Column functions against known values and plain Python definitions."""

import hashlib
import json
import random
import re
from pathlib import PurePosixPath

import pytest
from examples import EXAMPLES
from pyspark.sql import functions as F

from cmdprism.functions import labels, numbers, payloads, signals
from cmdprism.functions import text as tx
from cmdprism.functions.features import FEATURES, FLAG_FEATURES, align_features, build_features

ODD_TEXTS = [
    None, "", " ", '"', '""', '" a "', '"a', "\t a\u00a0 b\n", "\x1c x \x1f", "A" * 15, "a" * 16, "a" * 39, "B" * 40,
    "12 34 5", "a12 34b 5_6 7", "é5 5é 7", "x|y&&z;", "REG.EXE   ADD", "reg\u2003add", "cmd /c dir", "CMD.EXE", "-EnCodedCommand",
    "wMiC \u017fchta\u017fks", "\u212aurl", "a.PS1' \".bat\" c.vbs'\" d.zipx", "'.cab'", "DÉJÀ VU straße ŒUF", "\u0663\u00b2\u2460 9",
    "日本語 テスト", "http://x.y/z 0x1F", "line\x00break\x01\x1b\\\"", "deadbeefdeadbeef 99",
]


def texts():
    rng = random.Random(5)
    alphabet = list("aZ09 \t\n\"'\\|&;=+/._-<>é²\u00a0\u2003ß")
    return ODD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i INT, t STRING")


def evaluate(frame, column):
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


# What each text becomes, worked out by hand.
NORMALIZED = {
    "": "", " ": "", '"': "", '""': "", '" a "': "a", '"a': '"a', "\t a\u00a0 b\n": "a b", "A" * 15: "a" * 15, "a" * 16: "<B64>", "B" * 40: "<B64>",
    "12 34 5": "<NUM> <NUM> <NUM>", "a12 34b 5_6 7": "a12 34b 5_6 <NUM>", "é5 5é 7": "é5 5é <NUM>", "x|y&&z;": "x|y&&z;",
    "REG.EXE   ADD": "reg.exe add", "http://x.y/z 0x1F": "http://x.y/z 0x1f", "deadbeefdeadbeef 99": "<B64> <NUM>", "-p 1-2,3": "-p <NUM>-<NUM>,<NUM>",
}


def test_normalized_command_of_known_texts(spark):
    df = spark.createDataFrame(list(enumerate(NORMALIZED)), "i INT, t STRING")
    assert evaluate(df, tx.normalize_commandline(F.col("t"))) == list(NORMALIZED.values())


def test_normalized_command_is_stable_and_masked(frame):
    once = evaluate(frame, tx.normalize_commandline(F.col("t")))
    assert once[0] == "" and all(x == x.strip() and "  " not in x for x in once)
    for text in once:
        bare = text.replace("<B64>", " ").replace("<NUM>", " ")
        assert not re.search(r"[A-Za-z0-9+/=]{16}", bare), text
        assert not re.search(r"(?<![^\W])[0-9]+(?![^\W])", bare), text


def test_cleaned_text_and_strip_match_definition(frame):
    assert evaluate(frame, tx.clean_command_text(F.col("t"))) == [re.sub(r"\s+", " ", t or "").strip().lower() for t in texts()]
    assert evaluate(frame, tx.strip(F.col("t"))) == [None if t is None else t.strip() for t in texts()]


def test_json_text_matches_json_module(frame):
    expected = [json.dumps(t, ensure_ascii=False) for t in texts()]
    assert evaluate(frame, tx.json_string(F.col("t"))) == expected


def test_basename_matches_posix_paths(spark):
    paths = ["", "a", "a/b", "a/b/", "/", ".", "..", "a/.", "./.", "a/..", "//x//", "C:\\W\\x.EXE", "/A/B.c", "a/./", "/.", "x/.y"]
    df = spark.createDataFrame(list(enumerate(paths)), "i INT, t STRING")
    assert evaluate(df, tx.basename(F.col("t"))) == [PurePosixPath(p).name.lower() if p else "" for p in paths]
    assert evaluate(df, tx.basename(F.col("t"), windows_paths=True))[11] == "x.exe"


def test_row_hash_of_odd_texts(frame):
    expected = [
        hashlib.sha256(json.dumps({"CommandLine": t, "SourceImage": None, "prompt": t}, ensure_ascii=False).encode()).hexdigest()
        for t in texts()
    ]
    assert evaluate(frame, tx.row_hash(F.col("t"), F.lit(None).cast("string"), F.col("t"))) == expected


def test_golden_identities(spark):
    rows = [(i, *e[:3]) for i, e in enumerate(EXAMPLES)]
    df = spark.createDataFrame(rows, "i INT, c STRING, s STRING, p STRING")
    assert evaluate(df, tx.row_hash(F.col("c"), F.col("s"), F.col("p"))) == [e[3] for e in EXAMPLES]
    assert evaluate(df, tx.group_key(F.col("s"), F.col("c"))) == [e[4] for e in EXAMPLES]


def test_golden_features(spark):
    df = spark.createDataFrame([(i, e[0], e[1]) for i, e in enumerate(EXAMPLES)], "i INT, CommandLine STRING, SourceImage STRING")
    for row, example in zip(build_features(df).orderBy("i").collect(), EXAMPLES):
        length, words, special, upper, digits, image, first, depth, flags = example[5]
        assert (row.cmd_length, row.cmd_token_count, row.num_special_chars) == (length, words, special)
        assert row.cmd_upper_ratio == pytest.approx(upper, abs=1e-6)
        assert (row.cmd_digit_count, row.source_image_base, row.cmd_exe_base, row.image_path_depth) == (digits, image, first, depth)
        assert {f for f in FLAG_FEATURES if row[f] == 1.0} == flags


# Features that are not zero or empty, worked out by hand: (text, count features, flags, first word).
KNOWN_FEATURES = [
    ("", (0, 0, 0, 0.0, 0), set(), ""),
    ("reg\u2003add", (7, 2, 0, 0.0, 0), {"has_reg_add"}, "reg"),
    ("REG.EXE   ADD", (13, 2, 0, 1.0, 0), {"has_reg_add"}, "reg.exe"),
    ("x|y&&z;", (7, 1, 4, 0.0, 0), {"has_pipe"}, "x|y&&z;"),
    ("cmd /c dir", (10, 3, 0, 0.0, 0), {"has_cmd"}, "cmd"),
    ("CMD.EXE", (7, 1, 0, 1.0, 0), {"has_cmd"}, "cmd.exe"),
    ("-EnCodedCommand", (15, 1, 0, 3 / 14, 0), {"has_encodedcommand"}, "-encodedcommand"),
    ("\u212aurl wMiC", (9, 2, 0, 3 / 8, 0), {"has_wmic"}, "kurl"),
    ("a.PS1' \".bat\" c.vbs'\" d.zipx", (28, 4, 0, 2 / 15, 1), {"has_suspicious_ext"}, "a.ps1'"),
    ("'.cab'", (6, 1, 0, 0.0, 0), {"has_suspicious_ext"}, "'.cab'"),
    ("DÉJÀ VU", (7, 2, 0, 1.0, 0), set(), "déjà"),
    ("\u0663\u00b2\u2460 9", (5, 2, 0, 0.0, 4), set(), "\u0663\u00b2\u2460"),
    ("http://x.y/z 0x1F", (17, 2, 0, 1 / 9, 2), {"has_download"}, "http://x.y/z"),
    ("B" * 40, (40, 1, 0, 1.0, 0), {"has_base64"}, "b" * 40),
    ("a" * 39, (39, 1, 0, 0.0, 0), set(), "a" * 39),
    ("powershell -ep ByPass iwr", (25, 4, 0, 2 / 21, 0), {"has_powershell", "has_bypass", "has_iwr"}, "powershell"),
    ("certutil & bitsadmin", (20, 3, 1, 0.0, 0), {"has_certutil", "has_bitsadmin"}, "certutil"),
    ("rundll32; mshta; schtasks", (25, 3, 2, 0.0, 2), {"has_rundll32", "has_mshta", "has_schtasks"}, "rundll32;"),
    ("Invoke-WebRequest FTP", (21, 2, 0, 6 / 19, 0), {"has_iwr", "has_download"}, "invoke-webrequest"),
]


def test_features_of_known_texts(spark):
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(KNOWN_FEATURES)], "i INT, t STRING")
    for row, (text, counts, flags, first) in zip(build_features(df, "t", "t").orderBy("i").collect(), KNOWN_FEATURES, strict=True):
        assert (row.cmd_length, row.cmd_token_count, row.num_special_chars) == counts[:3], text
        assert row.cmd_upper_ratio == pytest.approx(counts[3]) and row.cmd_digit_count == counts[4], text
        assert {f for f in FLAG_FEATURES if row[f] == 1.0} == flags, text
        assert row.cmd_exe_base == first, text


def test_features_of_odd_texts_hold_together(frame):
    for row, text in zip(build_features(frame, "t", "t").orderBy("i").collect(), texts(), strict=True):
        plain = text or ""
        assert row.cmd_length == len(plain)
        assert row.num_special_chars <= row.cmd_length and row.cmd_digit_count <= row.cmd_length
        assert row.cmd_token_count <= (row.cmd_length + 1) / 2 and 0.0 <= row.cmd_upper_ratio <= 1.0
        assert (row.cmd_exe_base == "") == (row.cmd_token_count == 0)
        assert row.image_path_depth == plain.count("\\") and "\\" not in row.source_image_base
        assert all(row[f] in (0.0, 1.0) for f in FLAG_FEATURES)


def test_tokens_are_counted_without_a_pattern(spark):
    cases = ["", " ", "\t\x1e\x1f", "a", " a", "a\x1e\x1fb", "\x1f\x1e a \x1e", "a\u3000\u2009b\x85", "\u200b a  b   c    d ", "\U0001f600\xa0x\n"]
    counted = build_features(spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i INT, t STRING"), "t", "t").select("i", "cmd_token_count")
    assert [r.cmd_token_count for r in counted.orderBy("i").collect()] == [len(t.split()) for t in cases]
    assert "split(" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_align_features_orders_and_fills(spark):
    df = spark.createDataFrame([("cmd.exe /c dir", "C:\\cmd.exe")], "CommandLine STRING, SourceImage STRING")
    wanted = ["cmd_length", "source_image_base", "cmd_exe_base", "custom_numeric"]
    out = align_features(build_features(df), wanted, ["source_image_base", "cmd_exe_base"])
    assert out.columns == wanted
    assert out.first()["custom_numeric"] == 0.0


def test_labels(spark):
    words = ["MALICIOUS", " benign ", "1", "2", "benign", "true", "01", "", None]
    df = spark.createDataFrame(list(enumerate(words)), "i INT, t STRING")
    assert evaluate(df, labels.label_from_text(F.col("t"))) == [1, None, 1, None, 0, None, 1, None, None]
    values = ["true", "1.0", "2", '"1.0"', '"Malicious"', "null", "[1]", "0"]
    df = spark.createDataFrame(list(enumerate(values)), "i INT, t STRING").withColumn("v", F.parse_json("t"))
    assert evaluate(df, labels.label_from_variant("v")) == [1, 1, None, None, 1, None, None, 0]


def test_fixed_decimals_match_c_rounding(spark):
    rng = random.Random(3)
    values = [0.0355, 0.5, 1.5, 2.5, 0.125, -0.125, 1e-9, 0.0005, 123456.785] + [rng.uniform(-300, 300) for _ in range(300)]
    values += [round(v, 3) + 0.0005 for v in values]
    df = spark.createDataFrame(list(enumerate(values)), "i INT, t DOUBLE")
    for digits in (0, 2, 3):
        got = evaluate(df, numbers.fixed(F.col("t"), digits))
        assert got == [f"{v:.{digits}f}" for v in values]
    assert evaluate(df, numbers.fixed(F.col("t"), 2, plus=True))[:2] == ["+0.04", "+0.50"]


def test_float_text_matches_json(spark):
    values = [0.5, 1.0, 1e-5, 0.0005, 0.00012345, 1e16, 123456789.0, 2.5e-7, 0.1, 1e7, 12345678.5]
    df = spark.createDataFrame(list(enumerate(values)), "i INT, t DOUBLE")
    assert evaluate(df, numbers.float_text(F.col("t"))) == [json.dumps(v) for v in values]


def test_signals(spark):
    df = spark.createDataFrame([(1.0, 250, 30)], "has_powershell DOUBLE, cmd_length INT, cmd_token_count INT")
    found = df.select(signals.build_signals(df.columns)).first()[0]
    assert found == ["Invokes PowerShell", "Very long command (~250 chars)", "Large number of command tokens (30)"]


def test_feature_phrase(spark):
    names = ["source_image_base_cmd.exe", "cmd_exe_base_", "has_cmd", "cmd_length", "source_image_base", "other"]
    df = spark.createDataFrame(list(enumerate(names)), "i INT, t STRING")
    assert evaluate(df, signals.feature_phrase(F.col("t"))) == [
        "Source executable is cmd.exe", "Command entry point is ", "Explicit cmd.exe chaining", "Long command strings",
        "Source executable", "other",
    ]


def test_parse_model_output(spark):
    answers = [
        '{"label": "malicious", "explanation": "Executes LOLBin."}', "Likely benign due to normal parent process.",
        "[1, 2]", '{"label": 1}', "", '{"explanation": " x "} }',
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "i INT, t STRING")
    got = evaluate(df, payloads.parse_model_output(F.col("t")))
    assert [(r.label, r.explanation) for r in got] == [
        ("malicious", "Executes LOLBin."), ("unknown", "Likely benign due to normal parent process."), ("unknown", "[1, 2]"),
        ("unknown", None), ("unknown", ""), ("unknown", '{"explanation": " x "} }'),
    ]


def test_parse_review_response(spark):
    answers = [
        '```json\n{"reason_good": true, "justification": "fine", "improvements": ["a", 2]}\n```', "no json",
        '{"reason_good": "false", "improvements": "one"}', '{"reason_good": [], "improvements": {"a": 1}}', "```{}```",
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "i INT, t STRING")
    got = evaluate(df, payloads.parse_review_response(F.col("t")))
    assert [(r.reason_good, r.justification, r.improvements) for r in got][:3] == [
        (True, "fine", ["a", "2"]), (False, "Could not parse judge response: no json", []), (True, "", ["one"]),
    ]
    assert got[3].reason_good is False and len(got[3].improvements) == 1
    assert got[4].justification == "Could not parse judge response: ```{}```"


def test_feature_list_is_complete():
    assert len(FEATURES) == 25 and len(set(FEATURES)) == 25


def test_model_output_is_parsed_once_per_text(spark):
    from cmdprism.catalog import all_queries

    plan = all_queries()["j9_prediction_to_prob"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_short_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """A small file of many rows: one split by its bytes, tasks by its rows."""
    from cmdprism.sources import tables

    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(tables, "SPREAD_ROWS", 4_000)
    assert tables.spread_small(df).rdd.getNumPartitions() == 25 and tables.spread_small(df).count() == 100_000
