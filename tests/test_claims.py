"""Claims, places, records and quotes against plain definitions."""

import bisect
import dataclasses
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import claim_tables as ct
from tallyloom.functions import offsets, quotes
from tallyloom.operators import claims, expect

# Places ------------------------------------------------------------------------------------------


def letter_by_letter(size, log):
    """For each character of the result the source that it stands for, kept character by character."""
    now = [(k, k + 1) for k in range(size)]
    for edits in log:
        new, at = [], 0
        for s, e, n in edits:
            first = now[s][0] if s < len(now) else size
            new += now[at:s] + [(first, now[e - 1][1] if e > s else first)] * n
            at = e
        now = new + now[at:]
    return now


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_composed_tables_against_letters(data):
    size = now = data.draw(st.integers(0, 14))
    log = []
    for _ in range(data.draw(st.integers(0, 5))):
        points = sorted(data.draw(st.lists(st.integers(0, now), max_size=6, unique=True)))
        edits = [(s, e, data.draw(st.integers(0, 3))) for s, e in zip(points[::2], points[1::2], strict=False)]
        if len(points) % 2:
            edits.append((points[-1], points[-1], data.draw(st.integers(1, 3))))
        log.append(edits)
        now += sum(n - (e - s) for s, e, n in edits)
    want, table = letter_by_letter(size, log), offsets.traced(size, log)
    assert table.size == len(want)
    for s in range(now):
        for e in range(s + 1, now + 1):
            assert tuple(int(x) for x in table.span(s, e)) == (want[s][0], want[e - 1][1])


RAW = [
    "Latency decreased from 20 milliseconds to 10 milliseconds. https://example.org/x \nMemory: 20 MiB",
    "大对象阈值（1MB）\n内存 latency 20秒 -> 10秒",
    "<!-- remove --> <b>Time</b>: 0.4101774 seconds. 0 Warning(s)\n0 Error(s)",
    "İΟΔΟΣ v1.2.3 abcdef1234 \nRuntime 2µs -> 1μs",
    "x" * 200 + "\n10x faster",
    "a control\x1ccharacter, then latency of 5 ms",
    "1.2.3́ latency of 7 ms",
    "",
]


def test_the_table_follows_the_steps():
    for raw in RAW:
        text, log = offsets.rewrite(raw, claims.normal_steps())
        want, table = letter_by_letter(len(raw), log), offsets.traced(len(raw), log)
        assert len(text) == len(want) == table.size
        assert [tuple(int(x) for x in table.span(k, k + 1)) for k in range(len(text))] == want


def test_steps_are_replacements():
    """Edits give the same text as replacing pattern by pattern, and skipped steps would have had nothing to do."""
    draw = random.Random(2)
    parts = [*"aAİß 12.-", "12 seconds", "5 µs", "20秒", "1.2.3-x ", "2024-01-02t", "x" * 125, "<b>", "a@b.c ", "https://x.y ", "deadbeef1", "→", "≈", "×3 ", "7 min", "9+ ", "4n ±", "co-authored-by: x\n", "（1）"]
    for _ in range(1500):
        raw = "".join(draw.choice(parts) for _ in range(draw.randrange(14)))
        want = raw
        for p, by in ct.STRIP_RAW:
            want = re.sub(p, by.replace("$", "\\"), want)
        want = want.lower()
        for p, by in ct.STRIP_LOWER:
            want = re.sub(p, by.replace("$", "\\"), want)
        assert claims.normalise_text(raw) == want


def test_claims_lead_back_to_the_raw_text(spark):
    """Control characters, combining marks, repeated keys with different texts, repeated rows and null keys have the claims of their own text."""
    rows = [(k, t) for k, t in enumerate(RAW)] + [(0, "memory 5 mb less"), (0, RAW[0]), (None, RAW[5]), (50, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = claims.extract_claims(df, "id", "text", snippets=True, quotes=True).collect()
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(t or "")
    for r in found:
        homes = [t for t in texts[r["key"]] if r["quote"] and r["quote"] in t and 0 <= r["raw_start"] < r["raw_end"] <= len(t)]
        assert homes and any(claims.normalise_text(t[r["raw_start"] : r["raw_end"]]).strip() == r["cue"].strip() for t in homes), r
    keys = [r["key"] for r in found]
    assert {5, 6, None} <= set(keys) and keys.count(None) == keys.count(5)
    assert "20 milliseconds to 10" in next(r["quote"] for r in found if r["key"] == 0 and r["dimension"] == "D1")
    plain = claims.extract_claims(df, "id", "text").collect()
    assert sorted(map(str, plain)) == sorted(str(type(plain[0])(**{c: r[c] for c in claims.CLAIM})) for r in found)
    normal = {r["id"]: r["n"] for r in df.filter("id > 0").select("id", claims.normalise(F.col("text")).alias("n")).collect()}
    assert normal[50] == "" and normal[5] == claims.normalise_text(RAW[5])


# Claims ------------------------------------------------------------------------------------------


def naive(raw, conf=claims.DEFAULT):
    """Claims of one text straight from the rules: every mark against every other."""
    text = claims.normalise_text(raw)
    begins = [m.start() for m in re.finditer(r"\S+", text)]
    if not begins:
        return []
    tok = lambda at: max(sum(b <= at for b in begins) - 1, 0)
    quantities = [(tok(m.start()), kind, m[0], m.start(), m.end()) for kind, p in ct.QUANTITIES.items() for m in re.finditer(p, text)]
    raw_cues = {d: [m.span() for m in re.finditer(p, text)] for d, p in conf.cues.items()}
    cues = {}
    for d, p in conf.cues.items():
        blotted = list(text)
        for s, e in (span for o in conf.hidden_from.get(d, []) for span in raw_cues[o]):
            blotted[s:e] = [c if c.isspace() else "█" for c in text[s:e]]
        cues[d] = [(tok(m.start()), tok(m.end() - 1), m[0], m.start(), m.end()) for m in re.finditer(p, "".join(blotted))]
    doubt = {tok(m.start()) for m in re.finditer(ct.HYPOTHETICAL, text)}
    for m in re.finditer(ct.PROSPECTIVE, text):
        stop = min(len(text), m.end() + ct.BLOCK_CHARS)
        cut = re.compile(ct.BLOCK_BREAK).search(text, m.end(), stop)
        doubt |= set(range(tok(m.start()), tok((cut.start() if cut else stop) - 1) + 1))
    near = lambda places, at, w: any(abs(p - at) <= w for p in places)
    raw_at = lambda names: [tok(s) for n in names for s, _ in raw_cues.get(n, [])]

    def nearest(at, kinds):
        best = None
        for kind in sorted(kinds):
            own = [q for q in quantities if q[1] == kind]
            # Of one kind: the last before, the first at or behind; the nearer, ties to the earlier.
            sides = [max((q for q in own if q[0] < at), default=None), min((q for q in own if q[0] >= at), default=None)]
            for q in sides:
                if q and abs(q[0] - at) <= ct.PAIR_WINDOW and (best is None or abs(q[0] - at) < abs(best[0] - at)):
                    best = q
        return best

    away = lambda t, c: 0 if c[0] <= t <= c[1] else min(abs(t - c[0]), abs(t - c[1]))
    out = []
    for d, own in cues.items():
        for c in own:
            if near(doubt, c[0], ct.EXCLUSION_WINDOW) or near(raw_at(conf.silenced_by.get(d, [])), c[0], ct.PAIR_WINDOW):
                continue
            q = nearest(c[0], conf.kinds[d])
            if q is None:
                continue
            rivals = []
            for o, others in cues.items():
                if o != d and q[1] in conf.kinds[o]:
                    rivals += [x for x in (max((x for x in others if x[0] < q[0]), key=lambda x: x[3], default=None), min((x for x in others if x[0] >= q[0]), key=lambda x: x[3], default=None)) if x]
            if any(away(q[0], x) < away(q[0], c) for x in rivals):
                continue
            if d == ct.FALLBACK and (near([x[0] for o in cues if o != d for x in cues[o]], q[0], ct.PAIR_WINDOW) or near([x[0] for x in quantities if x[1] in ct.UNIT_KINDS], q[0], ct.UNIT_WINDOW)):
                continue
            out.append((d, "cue+quantity", c[2], c[3], c[4], q[1], q[2], q[3], q[4]))
    for d, p, need, quiet in conf.self_sufficient:
        for m in re.finditer(p, text):
            at = tok(m.start())
            if near(doubt, at, ct.EXCLUSION_WINDOW) or near(raw_at(quiet), at, ct.PAIR_WINDOW) or (need and nearest(at, need) is None):
                continue
            out.append((d, "self-sufficient", m[0], m.start(), m.end(), "self", m[0], m.start(), m.end()))
    return out


_PIECES = (
    "latency|build time|time|memory|heap|throughput|cpu time|cpu usage|round trips|payload size|requests per second|request time|bundle size|energy|price|concurrency|performance|overhead|speedup|faster|compile times took|"
    "120 ms|3 seconds|20 MiB|1,200 req/s|5 kwh|$20|12.50 usd|3x faster|2 times faster|reduced by 40%|15% improvement|by 7%|from 3 to 5|9 -> 4|before: 12|old = 3|| 5 ms ||allocated\n| x | 5 kb ||900 items per second|8 threads|speedup of 3x|"
    "should|would|todo|Expected gains\n|\n\n|\n# heading\n|not measured|coverage|it|went|up|and|then|so|word|of|x"
).replace("|| 5 ms ||", "|¦5 ms¦|").replace("5 kb ||", "5 kb ¦|").replace("| x |", "¦ x ¦").split("|")
PIECES = [p.replace("¦", "|") for p in _PIECES]


def made_texts(n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choice(PIECES) for _ in range(draw.randrange(2, 40))) for _ in range(n)]


def got_claims(found, extra=()):
    out = {}
    for r in found.collect():
        out.setdefault((r["key"], *(r[c] for c in extra)), []).append(tuple(r[c] for c in claims.CLAIM[1:]))
    return {k: sorted(v) for k, v in out.items()}


def test_against_the_rules_on_a_thousand_texts(spark):
    texts = made_texts(1000, 7)
    got = got_claims(claims.extract_claims(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text"))
    want = {(k,): sorted(c) for k, t in enumerate(texts) if (c := naive(t))}
    assert got == want
    every = [c for own in want.values() for c in own]
    assert {c[0] for c in every} == set(ct.CUES) and {c[5] for c in every} == {*ct.QUANTITIES, "self"}
    for d, p, _, _ in ct.SELF_SUFFICIENT:
        assert any(c[0] == d and c[1] == "self-sufficient" and re.fullmatch(p, c[2]) for c in every), p


def test_configurations_in_one_pass(spark):
    base = claims.DEFAULT
    load = base.with_dimensions({"X1": r"\bword\b"}, {"X1": ["rate", "time", "pct"]}, [("X1", r"\bcoverage of \d+\b", [], [])])
    other = claims.Configuration(cues={"D1": r"\blatency\b", "D7": base.cues["D7"], "D0": base.cues["D0"]}, kinds={d: base.kinds[d] for d in ("D1", "D7", "D0")}, hidden_from={}, silenced_by={"D7": ["D1"]}, self_sufficient=base.self_sufficient[:2])
    confs = {"base": base, "load": load, "other": other}
    texts = made_texts(150, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = got_claims(claims.claims_by(df, "id", "text", confs), ["configuration"])
    assert got == {(k, n): sorted(c) for n, conf in confs.items() for k, t in enumerate(texts) if (c := naive(t, conf))}


def test_one_reading_for_all_configurations(spark, tmp_path):
    """What is left to decide reads marks; the texts' folder isn't in the plan any more."""
    spark.createDataFrame(list(enumerate(made_texts(40, 9))), "id long, text string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts")
    found = claims.claims_by(df, "id", "text", {str(k): claims.DEFAULT for k in range(5)})
    assert found.groupBy("configuration").count().count() == 5
    assert f"{tmp_path}/texts" not in " ".join(found.inputFiles())


def test_surroundings_once_for_all_configurations(spark, monkeypatch):
    """More configurations that have the same cues don't make more rows to be sorted."""
    made, table = [], claims.Scratch.table

    def noted(self, df, name):
        out = table(self, df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(claims.Scratch, "table", noted)
    df = spark.createDataFrame(list(enumerate(made_texts(30, 12))), "id long, text string")
    for n in (1, 5):
        claims.claims_by(df, "id", "text", {str(k): claims.DEFAULT for k in range(n)})
    one, five = (rows for name, rows in made if name == "seen")
    assert one == five > 0


def test_decisions_keep_little_for_each_mark_and_broadcast_none(spark, monkeypatch):
    """What surrounds a mark is kept as numbers, only of sorts that some decision asks for; cues meet quantities in a join that grows with the texts."""
    made, table = {}, claims.Scratch.table

    def noted(self, df, name):
        made[name] = out = table(self, df, name)
        return out

    monkeypatch.setattr(claims.Scratch, "table", noted)
    texts = [*made_texts(30, 13), "memory, latency and build time: 5 ms"]
    found = claims.extract_claims(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    assert {r["name"] for r in made["marks"].filter("role = 'raw_cue'").select("name").distinct().collect()} == {"D7"}
    assert not [c for c, kind in made["seen"].dtypes if kind.startswith(("struct", "array"))]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


# Records -----------------------------------------------------------------------------------------


def test_claims_by_record(spark):
    draw = random.Random(3)
    rows = [(k // 7, ("a", "b")[k % 2], k, None if k % 13 == 5 else t) for k, t in enumerate(made_texts(140, 10))]
    # Claims that cross records: a cue at the end of one, its quantity in the next; an empty record between.
    rows += [(99, "a", 0, "the latency"), (99, "a", 1, ""), (99, "a", 2, "is 5 ms"), (99, "a", 3, "allocated"), (99, "a", 4, "| x | 5 kb |")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, source string, n int, text string")
    got = sorted((r["id"], r["source"], r["dimension"], r["part"], r["words"], r["n"], r["record_start"], r["record_end"]) for r in claims.claim_records(df, ["id"], "source", "n", "text").collect())
    want = []
    for key in {(r[0], r[1]) for r in rows}:
        own = sorted((r[2], r[3]) for r in rows if (r[0], r[1]) == key and r[3] is not None)
        whole = "\n".join(t for _, t in own)
        text, places = claims.normalise_with_places(whole)
        at, bounds = 0, []
        for n, t in own:
            bounds.append((n, at, at + len(t)))
            at += len(t) + 1
        for c in naive(whole):
            for part, words, s, e in (("cue", c[2], c[3], c[4]), ("quantity", c[6], c[7], c[8])):
                lo, hi = (int(x) for x in places.span(s, e))
                want += [(*key, c[0], part, words, n, max(lo, b) - b, min(hi, z) - b) for n, b, z in bounds if b < hi and z > lo]
    assert got == sorted(want)
    assert len({w[5] for w in want if w[0] == 99 and w[2] == "D3" and w[3] == "cue"}) == 2


# Quotes ------------------------------------------------------------------------------------------


def plainly(text, form):
    return quotes.read_as(text, form)[0]


def spellings(quote, texts, form):
    """All source spellings of a quote, by looking at every stretch of every text."""
    needle = plainly(quote or "", form).strip()
    found = {t[s:e] for t in texts if t for s in range(len(t)) for e in range(s + 1, len(t) + 1) if not t[s].isspace() and not t[e - 1].isspace() and plainly(t[s:e], form).strip() == needle} if needle else set()
    return needle, found


def aligned(spark, asked, records, form="plain"):
    q = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(asked)], "n long, scope string, quote string")
    r = spark.createDataFrame(records, "scope string, text string")
    return {x["n"]: (x["original"], x["spellings"], x["problem"]) for x in quotes.align_quotes(q, r, ["scope"], "quote", "text", form).collect()}


def test_quotes_in_one_spelling_none_and_several(spark):
    first = "+- **First compilation**: PCH built in ~1.15s"
    records = [("a", first), ("a", None), ("a", "x  y\nz"), ("a", "x y z"), ("b", "foo_bar and 2*3, C++ -> D"), ("b", "foo_bar and 2*3, C++ -> D"), (None, "of no scope here"), ("a", first)]
    asked = [("a", "First compilation: PCH built in ~1.15s"), ("a", "PCH built in ~1.14s"), ("a", "x y z"), ("a", " ** "), ("b", "foobar"), ("b", "foo_bar"), ("b", "23"), ("b", "->"), ("b", "First compilation"), (None, "no scope"), ("a", None), ("b", "nd 2*3, C++ -")]
    got = aligned(spark, asked, records)
    assert got[0] == ("First compilation**: PCH built in ~1.15s", 1, None)
    assert got[1] == got[4] == got[6] == got[8] == (None, 0, "missing")
    assert got[2] == (None, 2, "ambiguous") and got[3] == got[10] == (None, 0, "empty")
    assert got[5] == ("foo_bar", 1, None) and got[7] == ("->", 1, None) and got[9] == ("no scope", 1, None) and got[11] == ("nd 2*3, C++ -", 1, None)
    with pytest.raises(expect.ExpectationError):
        quotes.require_quotes(spark.createDataFrame([("x",)], "q string"), spark.createDataFrame([("y",)], "t string"), [], "q", "t")
    kept = quotes.require_quotes(spark.createDataFrame([("x  y",)], "q string"), spark.createDataFrame([("a **x** y b",)], "t string"), [], "q", "t")
    assert [r["q"] for r in kept.collect()] == ["x** y"]


def test_quotes_against_every_stretch(spark):
    """Short texts of few words, so that quotes stand nowhere, once, and in several spellings."""
    draw = random.Random(6)
    words = ["a1", "b2", "**c**", "__d__", "`e`", "&amp;", "<b>f</b>", "<br>", "g\n", "(h)"]
    records = [(str(k % 5), " ".join(draw.choice(words) for _ in range(draw.randrange(1, 7))).strip()) for k in range(25)]
    for form in ("plain", "rendered"):
        asked = []
        for scope, text in records:
            w = plainly(text, form).strip().split(" ")
            n = draw.randrange(1, len(w) + 1)
            at = draw.randrange(len(w) - n + 1)
            asked.append((draw.choice([scope, "0"]), " ".join(w[at : at + n])))
        got = aligned(spark, asked, records, form)
        for k, (scope, quote) in enumerate(asked):
            needle, _ = spellings(quote, [], form)
            # Where the needle stands in the plain text, the source spelling is cut by the table of places.
            want = set()
            for text in (t for s, t in records if s == scope and needle):
                plain, places = quotes.read_as(text, form)
                for m in re.finditer(f"(?={re.escape(needle)})", plain):
                    lo, hi = (int(x) for x in places.span(m.start(), m.start() + len(needle)))
                    inside = len(re.findall(r"\w+", needle)) > 2 or all(not (0 < at < len(plain) and re.match(r"\w\w", plain[at - 1 : at + 1])) for at in (m.start(), m.start() + len(needle)))
                    if inside and plainly(text[lo:hi], form).strip() == needle:
                        want.add(text[lo:hi])
            assert got[k][1] == len(want) and got[k][0] == (want.pop() if len(want) == 1 else None), (form, scope, quote)


def test_spelling_definition_on_small_texts(spark):
    """What is cut is among the stretches that read as the quote does."""
    texts = ["see **a b** c", "x <b>a b</b> y &amp; z", "a  b"]
    for form, quote in (("plain", "a b"), ("rendered", "a b"), ("rendered", "y & z")):
        got = aligned(spark, [("s", quote)], [("s", t) for t in texts], form)[0]
        _, found = spellings(quote, texts, form)
        assert got[0] is None or got[0] in found


def test_rendered_pages_lead_back(spark):
    pages = ["<!DOCTYPE html><p class='a>b'>One &lt;b&gt; &amp; two</p><script>x<1</script> three<br/>four <!-- no --><i>fi</i>ve &copy;&#39;&nbsp;x", "plain 1 < 2 && 3 > 2", "", None]
    got = {r["key"]: r for r in quotes.rendered(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html").collect()}
    assert got[0]["rendered"] == " One <b> & two three four five ©' x" and got[1]["rendered"] == pages[1] and got[2]["rendered"] == "" and got[3]["rendered"] is None
    for k in (0, 1):
        for p in got[k]["places"]:
            if p["same"]:
                n = p["end"] - p["begin"]
                assert got[k]["rendered"][p["at"] : p["at"] + n] == pages[k][p["begin"] : p["end"]]
    assert aligned(spark, [("s", "two three four five ©")], [("s", pages[0])], "document")[0][0] == "two</p><script>x<1</script> three<br/>four <!-- no --><i>fi</i>ve &copy;"


def test_cues_are_looked_for_near_what_may_be_claimed():
    """Marks within what a claim can ask for are those of a search of the whole text; those far from any quantity are left out."""
    patterns = claims.pattern_table([claims.DEFAULT, claims.DEFAULT.with_dimensions({"X": r"\b(?:load|loads)\b", "Y": r"went.*gone"}, {"X": ["time"], "Y": ["pct"]})])
    rng = random.Random(5)
    words = [*"the of load latency build time build-time memory should not yet tested throughput queries faster cpu i/o cost bundle size reduced by expected to".split(), "\n\n", "\n# Expected gains\n"]
    shown = ["120 ms", "40%", "from 12 min to 5 min", "3x faster", "1,200 req/s", "| 5 ms |", "went 9 and gone", "faster | | by 12%"]
    cut = 0
    for _ in range(60):
        text = " ".join(rng.choice(shown) if rng.random() < 0.01 else rng.choice(words) for _ in range(600))
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        token = lambda c: bisect.bisect_right(starts, c) - 1  # noqa: B023, E731
        near, every = (claims.find_marks(text, patterns, starts, reach) for reach in (claims.CUE_REACH, 10**6))
        base = [m for m in every if m[0] in ("quantity", "self")]
        asked = lambda m: m[0] in ("quantity", "self", "block") or any(token(b[3]) - 25 <= token(m[3]) <= token(b[4] - 1) + 25 for b in base)  # noqa: B023, E731
        assert set(filter(asked, every)) == set(filter(asked, near)) and set(near) <= set(every)
        cut += len(every) - len(near)
    assert cut > 0


def test_steps_that_concern_nothing_are_left_out_without_a_change():
    """Texts rewritten by all steps and by those that concern them are the same; what one step makes is seen by the next."""
    rng = random.Random(6)
    parts = [*"5 12 3.4.5 2024-01-02 + ms 毫秒 ナノ秒 倍 seconds s MB µs n ± x@y.zz deadbee1 時間 、 ( ~ - % v1.2.3 Hours hrs".split(), "a" * 130, " ", "\n"]
    steps = claims.normal_steps()
    for _ in range(3000):
        raw = want = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 12)))
        for s in steps:
            want = s.run(want)[0]
        assert claims.normalise_text(raw) == want


def test_plain_prose_runs_no_pattern_of_the_steps():
    """Words without anything that a step is about are told by substrings and landmarks alone."""
    prose = "Ein Wörterbuch über Straßen, and 42 plain words about it - nothing else, 7 of them twice. " * 40
    steps = [s for s in claims.normal_steps() if isinstance(s, offsets.Step)]
    assert not [s.pattern.pattern for s in steps if s.concerns(prose, {})]
    # Units are looked for where numbers end, however long the text is.
    units = [s for s in steps if s.at is not None]
    assert len(units) == sum(p.startswith(r"(?<=\d)\s*") for p, _ in ct.STRIP_LOWER) and all(len(list(s.at(prose))) == 80 for s in units)


def test_steps_and_marks_are_those_of_the_plain_patterns():
    """Texts rewritten by plain substitution, and landmarks, rules and headings searched for plainly, with digits and blanks of any script."""
    rng = random.Random(11)
    parts = [*"5 12 3.4.5 2024-01-02 + ms 毫秒 ナノ秒 倍 seconds s MB µs n ± x@y.zz deadbee1 ab12cd 時間 、 ( - % v1.2.3 Hours ٣٤ × → -> => ≈ – <b> <!-- --> http://a.b www.x 5minutes 7bytes ß 高速化 12x speed-up faster of by 加速 3%".split()]
    parts += ["a" * 119, "b" * 120, " ", "\x1f", "\x85", " ", "\n", "\n# Expected gains\n", "allocated\n", "| 5 kb |", "Link to Devin run: x\n"]
    patterns = claims.pattern_table([claims.DEFAULT])
    rules = [(str(k), p) for k, (_, p, _, _) in enumerate(ct.SELF_SUFFICIENT)]
    for _ in range(1500):
        raw = want = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14)))
        for p, by in ct.STRIP_RAW:
            want = re.sub(p, by, want)
        want = want.lower()
        for p, by in ct.STRIP_LOWER:
            want = re.sub(p, by.replace("$", "\\"), want)
        assert claims.normalise_text(raw) == want
        for text in (raw, want):
            marks = claims.Landmarks(text)
            assert marks.starts == [m.start() for m in re.finditer(r"\S+", text)] and marks.digits == [m.span() for m in re.finditer(r"\d+", text)]
            for n in (1, 2, 7, 120):
                assert (marks.has_token(n), marks.has_hex(n)) == (bool(re.search(rf"\S{{{n}}}", text)), bool(re.search(f"[0-9a-f]{{{n}}}", text)))
        found = claims.find_marks(want, patterns)
        assert sorted((m[1], *m[3:]) for m in found if m[0] == "self") == sorted((k, *m.span()) for k, p in rules for m in re.finditer(p, want))
        assert {m[3] for m in found if m[0] == "block"} <= {m.start() for m in re.finditer(ct.PROSPECTIVE, want)}
        assert not found or sum(m[0] == "block" for m in found) == len(re.findall(ct.PROSPECTIVE, want))


def made_by(parsed):
    """The texts that a pattern's parts make, with repeats done as seldom as they can be and once more."""
    out = [""]
    for op, given in parsed:
        op = str(op)
        if op == "LITERAL":
            each = [chr(given)]
        elif op == "IN":
            each = [chr(x) if str(kind) == "LITERAL" else {"CATEGORY_DIGIT": "0", "CATEGORY_SPACE": " "}.get(str(x), "a") for kind, x in given]
        elif op == "BRANCH":
            each = [x for branch in given[1] for x in made_by(branch)]
        elif op == "SUBPATTERN":
            each = made_by(given[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            each = ["".join(x) for n in range(given[0], min(int(given[1]), given[0] + 1) + 1) for x in itertools.product(made_by(given[2]), repeat=n)]
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
            each = [""]
        out = [a + b for a in out for b in dict.fromkeys(each)]
    return out


def test_whatever_a_cue_finds_holds_one_of_its_words():
    """Cues are run where a word of theirs is: no alternative of any of them is without one."""
    for d, p in ct.CUES.items():
        found = made_by(re._parser.parse(p))
        assert len(found) > 10 and not [x for x in found if not any(w in x for w in claims._CUE_WORDS[d])]


def test_patterns_that_begin_with_numbers_are_tried_at_numbers():
    """Quantities are those of a plain search, with tildes, separators, other digits and units ahead of numbers; numbers without a word of a cue beside them run no cue."""
    rng = random.Random(12)
    parts = "~ 5 1,200 3.5 12 x times faster % percent ms s (ms) (s) : = kb mb/s req/s n ± 10b 5ms ~7 ٣ $5.20 € before: after | -> from to 1990s word .5 a5 reduced by per second threads memory".split()
    patterns = claims.pattern_table([claims.DEFAULT])
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 14)))
        found = [m for m in claims.find_marks(text, patterns) if m[0] == "quantity"]
        assert not found or sorted((m[1], *m[3:]) for m in found) == sorted((kind, *m.span()) for kind, p in ct.QUANTITIES.items() for m in re.finditer(p, text))
    asked = []

    class Watched:
        def __init__(self, p):
            self.p, self.pattern = p, p.pattern

        def finditer(self, *at):
            asked.append(self.pattern)
            return self.p.finditer(*at)

    watched = dataclasses.replace(patterns, cues=[(d, Watched(p), bits, short) for d, p, bits, short in patterns.cues])
    claims.find_marks("the word and 12 ms of it, the latency " * 3, watched)
    assert set(asked) == {ct.CUES["D1"]}


def test_quotes_bring_no_whole_texts(spark):
    """What marks carry for quotes is as long as what they can be paired with, however long their text is; quotes are those of the whole text."""
    far = "word " * 4000
    text = f"{far}latency <!-- cut --> went **from 20 milliseconds** to 10 ms {far}\n| **5 ms** | memory 3 MB {far}"
    df = spark.createDataFrame([(1, text), (2, "memory 3 MB less")], "id long, text string")
    found = claims.marks(df, "id", "text", quotes=True).collect()
    assert {m["role"] for m in found} <= {"quantity", "cue", "raw_cue", "self", "hypothetical", "block"}
    assert max(len(v) for m in found for v in m if isinstance(v, str)) < 400
    got = claims.extract_claims(df, "id", "text", quotes=True).collect()
    want = {1: text, 2: "memory 3 MB less"}
    for r in got:
        lo, hi = min(r["raw_start"], r["quantity_raw_start"]), max(r["raw_end"], r["quantity_raw_end"])
        assert r["quote"] == want[r["key"]][lo:hi]
    assert any("<!-- cut -->" in r["quote"] for r in got) and {r["key"] for r in got} == {1, 2}


def test_records_of_claims_read_no_text_again(spark, tmp_path):
    """Where pieces stand in their joined text comes from sizes kept beside it; null keys, null orders and null texts as by ``record_boundaries``."""
    rows = [(k % 3 or None, "ab"[k % 2], k % 4 if k % 5 else None, None if k % 7 == 0 else "latency 5 ms " * (k % 3)) for k in range(40)]
    spark.createDataFrame(rows, "id long, source string, n long, text string").write.parquet(f"{tmp_path}/pieces")
    pieces = spark.read.parquet(f"{tmp_path}/pieces")
    want = claims.record_boundaries(pieces, ["id"], "source", "n", "text")
    got = claims.joined_boundaries(claims.joined_pieces(pieces, ["id"], "source", "n", "text"), ["id"], "source", "n")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert not [f for f in claims.claim_records(pieces, ["id"], "source", "n", "text").inputFiles() if str(tmp_path) in f]
