import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from docflow.functions import paths
from docflow.operators import rules, ruletable
from docflow.sources.listings import from_repo

REPO = ["GUIDE.md", "app.py", "lib/io.py", "lib/sub/tests/case.py", "notes/log.txt", "pics/a.png", "tests/unit.py"]
CODE = ["app.py", "lib/io.py", "notes/log.txt"]


def frame(spark, values, name="file_path"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def kept(df, name="file_path"):
    return sorted(r[name] for r in df.collect())


@pytest.mark.parametrize("include, exclude, expected", [
    ([], rules.PRESETS["repository"], CODE),
    ([r"\.md$"], [], ["GUIDE.md"]),
    ([r"\.py$"], ["/"], ["app.py"]),
    ([], [], REPO),
    (None, None, REPO),
])
def test_keep_lists(spark, include, exclude, expected):
    once = rules.apply_rules(frame(spark, REPO), "file_path", include, exclude)
    assert kept(once) == expected
    assert kept(rules.apply_rules(once, "file_path", include, exclude)) == expected


def test_invalid_patterns_are_reported_and_count_as_absent(spark):
    with pytest.warns(UserWarning, match="invalid pattern"):
        assert kept(rules.apply_rules(frame(spark, REPO), "file_path", ["("], [])) == REPO
    with pytest.warns(UserWarning):
        assert rules.valid_patterns(["(", "a", "["]) == ["a"]


@pytest.mark.parametrize("pattern", [
    r"(?P<q>['\"]).*(?P=q)", r"b\Z", r"\\Z", r"^\w+$", r"\d", r"a.c", r"b$", r"[\s]x", r"(?i)ABC", r"(a)\1", r"a{2}", r"\(\?P<x"])
def test_patterns_find_what_they_find_in_python(spark, pattern):
    values = ["'x'", "'x\"", "ab", "ab\n", r"a\Z", "şeker", "٣", "a\nc", "abc", "a\u00a0x", "aab", "(?P<x", ""]
    found = rules.apply_rules(frame(spark, values), "file_path", [pattern])
    assert kept(found) == sorted(v for v in values if re.search(pattern, v))


def test_missing_key_is_the_empty_string(spark):
    df = frame(spark, [None, "a"])
    assert rules.apply_rules(df, "file_path", [], ["b"]).count() == 2
    assert kept(rules.apply_rules(df, "file_path", ["a"], [])) == ["a"]
    assert rules.apply_rules(df, "file_path", ["^$"], []).count() == 1


def test_reader_exclusion_then_substrings(spark):
    files = from_repo(frame(spark, REPO), ["node_modules", "dist", "tests"], [".png", ".jpg", ".md"])
    files = files.withColumn("file_name", paths.file_name(F.col("file_path")))
    assert kept(rules.apply_substring_rules(files, [], ["TEST"])) == CODE
    assert kept(rules.apply_substring_rules(files, ["LIB", "app"], [])) == ["app.py", "lib/io.py"]


def test_a_file_named_like_a_skipped_folder_stays(spark):
    assert kept(from_repo(frame(spark, ["tests", "a/tests", "tests/a"]), ["tests"], [])) == ["a/tests", "tests"]


def test_vault(spark):
    notes = frame(spark, ["v/note.md", "v/.obsidian/a.md", "v/.trash/a.md", "v/.git/a.md", "v/temp/a.md", "v/_draft/a.md",
                          "v/a.txt"])
    notes = notes.withColumn("file_extension", paths.file_extension(paths.file_name(F.col("file_path"))))
    assert kept(rules.apply_vault_rules(notes, rules.VAULT_INCLUDE, rules.PRESETS["vault"])) == ["v/note.md"]
    # without rules of the caller the built-in ones still hold
    assert kept(rules.apply_vault_rules(notes)) == ["v/_draft/a.md", "v/note.md", "v/temp/a.md"]


@pytest.mark.parametrize("preset, values, expected", [
    ("issues", ["APP-1", "TEST-1", "APP-BUG", "EPIC-9"], ["APP-1"]),
    ("posts", ["plain words", "see http://a.b/c", "RT @bob: hi", "hi @bob", "a #tag", "mail @ home"],
     ["mail @ home", "plain words"]),
    ("key_value", ["cache:x", "system:load", "lock:gate", "queue:mail", "a.bin",
                   "garden:7:bed", "temp:kiln", "session_1"], ["garden:7:bed", "session_1", "temp:kiln"]),
    ("drive", ["a/.git/x", "a.log", "a/temp/b", "a.zip", "a.gif", "a.txt"], ["a.txt"]),
])
def test_presets(spark, preset, values, expected):
    assert kept(rules.apply_rules(frame(spark, values), "file_path", [], rules.PRESETS[preset])) == expected


def test_a_very_long_url_does_not_overflow_the_matcher(spark):
    text = frame(spark, ["http://" + "a" * 200_000, "http://"])
    assert kept(rules.apply_rules(text, "file_path", [], rules.PRESETS["posts"])) == ["http://"]


@pytest.mark.parametrize("name, extension, stem, kind", [
    ("a.PDF", "pdf", "pdf", "pdf"), ("noext", "", "", "noext"), (".pdf", "pdf", "", "pdf"),
    ("a.tar.gz", "gz", "gz", "gz"), ("a..b", "b", "b", "b"), ("x.", "", "", ""),
])
def test_path_parts(spark, name, extension, stem, kind):
    c = F.col("n")
    row = frame(spark, [name], "n").select(paths.file_extension(c), paths.splitext(c), paths.file_type(c)).first()
    assert tuple(row) == (extension, stem, kind)


def test_supported_extensions(spark):
    files = frame(spark, ["a.pdf", "b.exe", "old/c.TXT"]).withColumn(
        "file_extension", F.substring_index("file_path", ".", -1))
    assert kept(rules.apply_supported_rules(files, [], ["^old/"])) == ["a.pdf"]


def test_literal_runs():
    assert ruletable.literal_runs(r"^abc\.d+e?f[xy]*ghi\d$") == ["abc.d", "f", "ghi"]
    assert ruletable.literal_runs(r"a(b)c") == ruletable.literal_runs("ab|cd") == ruletable.literal_runs("(?i)abc") == []
    assert ruletable.literal_runs(r"\(ab\|c") == ["(ab|c"]


def test_a_rule_table_keeps_what_the_rules_keep(spark):
    source = random.Random(4)
    alphabet = ["ab", "abc", "x.md", ".py", "/tests/", "temp_", "RT @", "https://", "é", "日本", "(", "#tag", "__pycache__", "", " "]
    keys = ["".join(source.choice(alphabet) for _ in range(source.randint(0, 6))) for _ in range(300)] + [None, "", "ab"] + ["hot/tests/a"] * 200
    frame_ = spark.createDataFrame(list(enumerate(keys)), "_g long, file_path string").withColumn("_rules", F.lit("own"))
    presets = [p for listed in rules.PRESETS.values() for p in listed]
    odd = ["abc", "a.c", r"\.md$", "^ab", "x", "(ab|x)", r"\(", "[", "日本", r"temp_+\.?", "éab*", r"/tests/.*\.py", "abcab"]
    for include, exclude in [([], presets), (odd, []), (odd[:3], presets), (["["], ["abc"]), (["zzz"], []), ([], []), (odd[5:], odd[:1])]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            table = spark.createDataFrame([(p, False) for p in include] + [(p, True) for p in exclude] * 2 + [(None, True)], "pattern string, exclude boolean")
            got = ruletable.apply_rule_table(frame_, "file_path", table)
            want = rules.apply_rules(frame_, "file_path", include, exclude)
            assert got.columns == frame_.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_pieces_are_found_without_an_expression_per_character(spark, monkeypatch):
    """Keys cut anywhere keep all their pieces, none spans two keys, and a rule with a piece that no key has is not searched."""
    monkeypatch.setattr(ruletable, "TOGETHER", 4)
    keys = ["abcdef" * 3, "xyz", "\U0001F600ab日", "ab", "", None, "cde", "f", "abc"]
    rows = frame(spark, keys)
    keyed = rows.select(F.monotonically_increasing_id().alias("_g"), F.coalesce("file_path", F.lit("")).alias("_key")).coalesce(1)
    grams = ["abc", "cde", "fab", "yza", "zab", "\U0001F600ab", "ab日", "cxy", "zzz", "def"]
    texts = {r._g: r._key for r in keyed.collect()}
    found = ruletable._found(keyed, grams).distinct().collect()
    assert sorted((r._g, r.gram) for r in found) == sorted((g, p) for g, t in texts.items() for p in grams if p in t)
    times = {r.gram: r.n for r in ruletable._times(keyed, grams).collect()}
    assert all(times.get(p, 0) >= sum(p in t for t in texts.values()) for p in grams) and "zzz" not in times
    table = spark.createDataFrame([("abcd", False), ("abczzz", False), ("\U0001F600ab", False), ("cxyz", True)], "pattern string, exclude boolean")
    out = ruletable.apply_rule_table(rows, "file_path", table)
    assert kept(out) == kept(rules.apply_rules(rows, "file_path", ["abcd", "abczzz", "\U0001F600ab"], ["cxyz"]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "transform(" not in plan


def test_the_plan_of_a_rule_table_does_not_grow(spark):
    def plan(n):
        table = spark.createDataFrame([(f"name{i}x", True) for i in range(n)], "pattern string, exclude boolean")
        text = ruletable.apply_rule_table(frame(spark, REPO), "file_path", table)._jdf.queryExecution().optimizedPlan().toString()
        return len(re.sub(r"\d+", "", text))

    assert plan(2000) == plan(3)
    with pytest.raises(ValueError, match="without"):
        ruletable.apply_rule_table(frame(spark, REPO), "file_path", spark.createDataFrame(
            [(f"(n{i})", True) for i in range(ruletable.MOST_LOOSE + 1)], "pattern string, exclude boolean"))
