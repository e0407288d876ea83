"""Large catalogues and findings by content, against unrolled scans."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.functions import rules
from reviewloom.functions.required import required
from reviewloom.operators.catalogues import folded, scan_catalogue
from reviewloom.operators.scan import scan
from reviewloom.sources import contents


def plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize(
    "regex, want",
    [
        ("eval\\(", {"eval("}), ("a|b", None), ("foo|barre", {"foo", "barre"}), ("(?:foo)?x", None), ("(foo|bar)+baz?", {"foo", "bar"}),
        ("ab+cdef", {"bcdef"}), ("abc*d", None), ("x{2}yz\\.w", {"xyz.w"}), ("(?=look)behind", {"behind"}), ("[abc]def\\sghij", {"ghij"}),
        ("\\bword\\b", {"word"}), ("\\x41bcd|\\u0041bc", {"bcd"} and None), ("a{0,3}bcd", {"bcd"}), ("^start.*stop$", {"start"}), ("", None),
        ("(a(b|c)long)|(other)", {"long", "other"}), ("new\\s+Function\\(", {"Function("}), ("unclosed)", None), ("q{3", {"q{3"}),
    ],
)
def test_required_strings(regex, want):
    assert required(regex) == (None if want is None else frozenset(want))


ATOMS = st.sampled_from(["a", "b", "abc", "\\.", "\\s", "\\b", "[ab]", ".", "x", "(?:ab|ba)", "(abc|x)", "(?=a)", "(?!b)", "^", "a|b"])
PARTS = st.tuples(ATOMS, st.sampled_from(["", "", "", "*", "+", "?", "{2}", "{0,1}", "+?"])).map(lambda p: p[0] if p[0] in ("^", "a|b", "\\b") else "".join(p))


@given(st.lists(PARTS, min_size=1, max_size=6).map("".join), st.text("abxABX. c\n", max_size=25))
@settings(max_examples=1500, deadline=None)
def test_no_match_without_a_required_string(regex, text):
    strings = required(regex)
    for flags in (0, re.IGNORECASE):
        if strings is not None and re.search(regex, text, flags):
            assert any(folded(s) in folded(text) for s in strings)


def test_built_in_rules_match_nothing_without_their_strings():
    gated = [p for p in rules.PATTERNS.values() if required(p.regex)]
    assert len(gated) > len(rules.PATTERNS) / 2


def own_rules(spark, n):
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    shapes = [lambda: f"{word()}\\s*\\(", lambda: f"\\b{word()}\\b", lambda: f"{word()}|{word()}", lambda: f"(?:{word()})+\\.{word()}?", lambda: f"^{word()}.*;"]
    rows = [(f"R{i}", i, "security", f"T{i % 7}", "high", r.choice(shapes)(), i % 3 == 0, "n", "a") for i in range(1, n)]
    rows.append((f"R{n}", n, "security", "T", "low", "[xyz]{3}", False, "n", "a"))  # requires nothing
    schema = "rule_id string, rule_ord int, kind string, type string, level string, regex string, ignore_case boolean, note string, advice string"
    return rules.from_table(spark.createDataFrame(rows, schema))


def files(spark, pack, n):
    r = random.Random(1)
    words = re.findall("[a-j]{5}", " ".join(p.pattern.regex for p in pack))
    line = lambda: " ".join(r.choice(words) + r.choice(["", "(", ".", ";", " (", "xyz"]) for _ in range(6))
    texts = ["\n".join(line().upper() if r.random() < 0.2 else line() for _ in range(8)) for _ in range(n)]
    rows = [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "é abc\n" + words[0] + "(")]
    return spark.createDataFrame(rows, "id int, content string").repartition(4)


def test_two_thousand_rules(spark):
    pack = own_rules(spark, 2000)
    df = files(spark, pack, 400)
    begin = time.perf_counter()
    got = plain(scan_catalogue(df, pack))
    gated = time.perf_counter() - begin
    want = sorted(x for i in range(0, 2000, 250) for x in plain(scan(df, pack[i : i + 250])))
    assert got == want and len(got) > 1000
    begin = time.perf_counter()
    plain(scan(df, [r for p in rules.ALL_PACKS for r in p]))
    assert gated < 8 * (time.perf_counter() - begin)


def test_small_catalogues_and_shared_orders(spark):
    pack = own_rules(spark, 12)
    df = files(spark, pack, 20)
    assert plain(scan_catalogue(df, pack[-1:])) == plain(scan(df, pack[-1:]))
    assert scan_catalogue(df, []).count() == 0
    with pytest.raises(ValueError):
        scan_catalogue(df, [pack[0], pack[0]])


def test_only_new_contents_are_scanned(spark, tmp_path):
    pack, path = rules.CODE_SECURITY, str(tmp_path)
    rows = [(i, f"eval({i % 5})\ninnerHTML = x") for i in range(40)] + [(50, None), (51, ""), (52, "clean")]
    df = spark.createDataFrame(rows, "id int, content string").repartition(3)
    stored = lambda n: spark.read.parquet(f"{contents.catalogue_folder(path, pack)}/batch={n}")
    contents.scan_new(df.where("id < 3"), pack, path, 0)
    contents.scan_new(df, pack, path, 1)
    contents.scan_new(df, pack, path, 1)  # the batch runs again, and finds what it wrote
    contents.scan_new(df, pack, path, 2)
    assert [stored(n).count() for n in range(3)] == [3, 0, 4]
    assert plain(contents.attached(df, pack, path, "id")) == plain(scan(df, pack))
    assert contents.attached(df, rules.CODE_PERFORMANCE, path, "id").count() == 0  # another catalogue, another folder
    assert contents.known(spark, contents.catalogue_folder(path, pack)).count() == 7
