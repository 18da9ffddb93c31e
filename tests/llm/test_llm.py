"""Training-data operators against brute force, round trips and hand-made cases; nulls, ties, repeats and empty tables."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import capping, encoding, lookalike, mixing, neardup, packing, scannoise, sentences, splitting
from folioscope.llm import queries as q

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1 look-alikes


def fields(spark, values):
    return spark.createDataFrame([("t", str(i), "f", v) for i, v in enumerate(values)], "source_table string, record_id string, field string, text string")


def test_plain_forms(spark):
    clean = ["THE QUICK BROWN FOX JUMPS OVER A LAZY DOG, the quick brown fox jumps over a lazy dog", "опыт показал рост на входе и в сопле", "Λ_x and κ_θ", "é ß ü — ¬", None, "", "plain\ttab"]
    dirty = {"thе plаte": "the plate", "ﬁlm ﬂow": "film flow", "éte": "éte", "a​b": "ab", "x y　z": "x y z", "Ｒｅ": "Re", "𝑅е_{θ}": "Re_{θ}", "start‑up": "start-up", "тeпловой рост": "тепловой рост", "Τu": "Tu", "u‍̈": "ü"}
    df = fields(spark, clean * 5 + list(dirty))
    symbols = spark.createDataFrame([("Λ κ θ γ δ",)], "text string")
    got = {r.text: (r.plain, r.changed) for r in lookalike.plain_forms(df, symbols).collect()}
    for x in clean:
        assert got[x] == (x, False)
    for x, y in dirty.items():
        assert got[x] == (y, True), x
    assert {r.text for r in lookalike.plain_forms(df, symbols, changed_only=True).collect()} == set(dirty)
    assert lookalike.plain_forms(df.where("false"), symbols).count() == 0


def test_plain_form_is_stable(spark):
    df = q._plain(spark, SF, True)
    again = df.select("source_table", "record_id", "field", F.col("plain").alias("text"))
    every = lookalike.fields_of(spark.read.parquet(f"{SF}/alias_sources.parquet"), spark.read.parquet(f"{SF}/structured_chunks.parquet"))
    both = every.unionByName(again.withColumn("source_table", F.lit("again")))
    assert lookalike.plain_forms(both, lookalike.glossary_texts(spark.read.parquet(f"{SF}/glossary.parquet")), True).where("source_table = 'again'").count() == 0


# --- 2 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing_equals_a_plain_version(sizes):
    bins, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        open_bins = [(r, b) for b, r in enumerate(bins) if r >= sizes[i]]
        if not open_bins:
            bins.append(50)
            open_bins = [(50, len(bins) - 1)]
        r, b = min(open_bins)
        bins[b] -= sizes[i]
        want[i] = b
    got = packing.best_fit_decreasing(sizes, 50)
    load = Counter()
    for s, b in zip(sizes, got):
        load[b] += s
    assert all(v <= 50 for v in load.values()) and len(load) == len({*want})


def packing_inputs(spark, items):
    return spark.createDataFrame(items, "query_id bigint, item_id string, content string, reader string"), spark.createDataFrame([(1, "brief"), (2, None), (3, "odd")], "query_id bigint, reader string"), spark.createDataFrame([("brief", 10), ("brief", 10)], "reader string, capacity int")


def test_packing(spark, monkeypatch):
    items = [(1, f"i{k}", "w " * (k % 7 + 1), "x") for k in range(200)] + [(1, "long", "a\tb\n" * 13, "x")] * 2 + [(1, "none", None, "x"), (1, "blank", " \n", "x"), (2, "a", "w", "x"), (3, "b", "w", "x")]
    monkeypatch.setattr(packing, "RUN", 7)
    monkeypatch.setattr(packing, "STEP", 5)
    got = packing.pack_items(*packing_inputs(spark, items)).collect()
    load, pieces = Counter(), Counter()
    for r in got:
        load[r.context] += r.words
        pieces[r.item_id] += 1
    assert max(load.values()) <= 10 and sum(load.values()) == sum(k % 7 + 1 for k in range(200)) + 26
    assert pieces["long"] == 3 and {i for i, n in pieces.items() if n > 1} == {"long"} and "none" not in pieces and {r.query_id for r in got} == {1}
    assert len(load) <= -(-sum(load.values()) // 10) + 2
    assert packing.pack_items(packing_inputs(spark, items)[0].where("false"), *packing_inputs(spark, items)[1:]).count() == 0


# --- 3 capping


@pytest.mark.parametrize("seed, states", [(1, 200_000), (2, 0)])
def test_capping_equals_brute_force(spark, monkeypatch, seed, states):
    monkeypatch.setattr(capping, "STATES", states)  # 0: bounds are never broadcast
    rng = random.Random(seed)
    data = []
    for _ in range(700):
        s = rng.choice([None, float("nan"), 1.0, 1.0, 2.5, float("inf"), float("-inf"), -1e300, 1e300, rng.random()])
        data.append((rng.choice([1, 1, 2, 3, 4, None]), f"{rng.choice(['same-long-prefix-', ''])}{rng.randrange(150)}", rng.choice(["hot", " HOT\t", "b", "c", None]), s, "x"))
    per = {}
    for qid, c, p, s, _ in data:
        s = float("-inf") if s is None or s != s else max(-1.7976931348623157e308, min(s, 1.7976931348623157e308))
        o = per.get((qid, c), (None, float("-inf")))
        p = p.strip().lower() if p else None
        per[qid, c] = (max(x for x in (o[0], p) if x is not None) if (o[0] or p) else None, max(o[1], s))
    limits = {1: ("cap", 5), 2: ("share", 10), 3: ("cap", 0)}
    total = Counter(k[0] for k in per)
    want = set()
    for (qid, c), (p, s) in per.items():
        if qid in limits and p is not None:
            how, n = limits[qid]
            cap = n if how == "cap" else max(1, total[qid] * n // 100)
            ahead = sum(1 for (q2, c2), (p2, s2) in per.items() if q2 == qid and p2 == p and (-s2, c2) < (-s, c))
            if ahead >= cap:
                want.add((qid, c))
    chunks = spark.createDataFrame(data, "query_id bigint, chunk_id string, paper_id string, rerank_score double, paper string")
    queries = spark.createDataFrame([(1, 5, None), (2, None, 10), (3, 0, None), (4, None, None)], "query_id bigint, paper_cap int, paper_share_pct int")
    got = capping.cap_contributors(chunks, queries)
    assert {(r.query_id, r.chunk_id) for r in got.where("not kept").collect()} == want
    assert got.count() == len(per)
    assert capping.cap_contributors(chunks.where("false"), queries).count() == 0
    for hot in (0, 20):  # 0: every contributor is large; 20: both kinds are there
        monkeypatch.setattr(capping, "HOT", hot)
        again = capping.cap_contributors(chunks, queries)
        assert {(r.query_id, r.chunk_id) for r in again.where("not kept").collect()} == want and again.count() == len(per)


def test_capping_broadcasts_nothing_for_small_contributors(spark, monkeypatch):
    def never(*_):
        raise AssertionError("bounds of contributors went to the driver")

    monkeypatch.setattr(capping, "_beside", never)
    chunks = spark.createDataFrame([(q, f"c{i}", f"p{i % 2}", float(i)) for q in range(300) for i in range(4)], "query_id bigint, chunk_id string, paper_id string, rerank_score double")
    queries = spark.createDataFrame([(q, 1, None) for q in range(300)], "query_id bigint, paper_cap int, paper_share_pct int")
    assert {(r.chunk_id, r.kept) for r in capping.cap_contributors(chunks, queries).collect()} == {("c0", False), ("c1", False), ("c2", True), ("c3", True)}


# --- 4 scanned pages


def test_edits():
    assert scannoise.edits("darnps", "damps") == [("m", "rn")] and scannoise.edits("pattem", "pattern") == [("rn", "m")] and scannoise.edits("flttecl", "fitted") == [("i", "l"), ("d", "cl")]
    assert scannoise.edits("alth0ugh", "although") == [("o", "0")] and scannoise.edits("plate", "walls") is None


def test_find_and_repair_noise(spark):
    rng = random.Random(3)
    words = "boundary layer pressure gradient turbulent transition surface measurement velocity profile friction roughness although reference spectrum amplitude instability vortex".split()
    line = lambda n=9: " ".join(rng.choice(words) for _ in range(n))
    pages = [(f"c{i}", "p", "a", 3, "\n".join(line() for _ in range(6))) for i in range(300)]
    pages += [("hyp", "p", "a", 3, line() + " bound-\nary layer " + line()), ("head", "p", "a", 3, line() + "\nSTEADY FLOW OVER\n" + line() + "\n" + line()), ("num", "p", "a", 3, line() + "\n- 12 -\n" + line() + "\n" + line()), ("mis", "p", "a", 3, line() + " turbulcnt\n" + line() + " O.86 percent"), ("susp", "p", "a", 3, line() + " pressure-\nand velocity-profile\n" + line()), ("nul", None, None, None, None), ("emp", "p", "a", 3, "")]
    chunks = spark.createDataFrame(pages + [pages[-5]], "chunk_id string, parent_id string, paper_id string, page int, content string")
    papers = spark.createDataFrame([("a", "Steady flow over rough walls", ["B. Nobody"], 1999, "Annals of Flow", "10-20")], "paper_id string, title string, authors array<string>, pub_year int, journal string, pages string")
    got = {(r.chunk_id, r.kind) for r in scannoise.find_noise(chunks, papers).collect()}
    assert got == {("hyp", "hyphenation"), ("head", "header"), ("num", "page_number"), ("mis", "misread")}
    text = {r.chunk_id: r.text for r in scannoise.repaired(chunks, papers).where("chunk_id in ('hyp', 'head', 'num', 'mis')").collect()}
    assert "boundary layer" in text["hyp"] and "STEADY" not in text["head"] and "- 12 -" not in text["num"] and "turbulent" in text["mis"] and "0.86" in text["mis"]


def test_furniture_beside_a_table():
    table = "| plate | wake |\n|---|---|\n| 4.9 | K-71 |\n| 12 | 13 |"
    assert scannoise.table_lines(f"a\n| 12\n{table}\n| 13\nb".split("\n")) == {2, 3, 4, 5}
    assert scannoise.table_lines(["| 12", "text | with | bars"]) == set()
    paper = scannoise.Paper("Steady flow over rough walls", ["B. Nobody"], "Annals of Flow", "10-20", 1999)
    text = "The wake of the plate was measured at\nthe lowest speed and near the wall of\n\nPage 12\nSTEADY FLOW OVER\n\nthe tunnel with a probe that had been\ncalibrated before and after the runs."
    lines = scannoise.train_lines([paper], [text, text.replace("\n\nPage 12\nSTEADY FLOW OVER\n", "")])
    reader = scannoise.Reader({}, {}, lines, scannoise.train_pairs([], {}.get), scannoise.Mixed({}, {}))
    for whole in (f"{text}\n\n{table}", f"{table}\n\n{text}"):
        kinds, out = reader.read([whole], [paper], [[3]], repair=True)[0]
        assert kinds == {"header", "page_number"}
        assert table in out and "STEADY" not in out and "Page 12" not in out
        assert "at the lowest" in out and "been calibrated" in out
    assert reader.read([table], [paper], [[3]], repair=True)[0] == (set(), table)


def test_all_confusions_count(spark, monkeypatch):
    counts = scannoise.word_counts(spark.read.parquet(f"{SF}/structured_chunks.parquet")).where("not word like '\0%'")
    one = rows(scannoise.corrections(counts))
    monkeypatch.setattr(scannoise, "USUAL", 3)  # the others come by a join
    assert one and [r[:2] for r in rows(scannoise.corrections(counts))] == [r[:2] for r in one]
    pairs = spark.createDataFrame([("cat", 1, "eat", 9), ("cxt", 1, "ext", 9), ("abcdef", 1, "ghijkl", 9)], "word string, n bigint, better string, m bigint")
    every = spark.createDataFrame([("e", "c", 7)], "printed string, read string, n bigint")
    assert [(r.word, r.least) for r in scannoise._with_least(pairs, every).orderBy("word").collect()] == [("cat", 7), ("cxt", 7)]


def test_long_keys_without_a_word_of_their_length_are_not_cut_into_grams(spark, monkeypatch):
    long = "boundarylayertransition" * 3
    keys = [f"{i:064x}" * 20 for i in range(48879, 48884)]  # ...beef and so on
    counts = spark.createDataFrame([(long, 90), (long.replace("ti", "tl", 1), 2), ("turbulent", 90), ("turbulcnt", 2), *((k, 1) for k in keys)], "word string, n bigint")
    cut_up, sharing = [], scannoise._sharing

    def recorded(words, better, name):
        if name == "id":
            cut_up.extend(r.size for r in words.select("size").collect())
        return sharing(words, better, name)

    monkeypatch.setattr(scannoise, "_sharing", recorded)
    assert rows(scannoise.candidates(counts)) == sorted([(long.replace("ti", "tl", 1), 2, long, 90), ("turbulcnt", 2, "turbulent", 90)])
    assert cut_up == [len(long)] * 2


_SCANNED = st.text(alphabet="aeOlSI015.,-/_ \n\t\r|¬=~–“é٣\x00\x85\x1c(", max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(_SCANNED, max_size=4))
def test_tokens_hold_what_the_patterns_find(texts):
    got = scannoise.tokens_of(texts).to_pylist()
    assert len(got) == len(texts)
    for text, tokens in zip(texts, got):
        for pattern in (scannoise._WORD, scannoise._WITH_DIGIT, scannoise._NUMBER, scannoise._CODE_READ):
            assert [m for x in tokens for m in pattern.findall(x)] == pattern.findall(text)
        assert any(scannoise._MIXED_TOKEN.search(x) for x in tokens) == bool(scannoise._MIXED_TOKEN.search(text))
        assert scannoise.may_break(text) or scannoise._BREAK.sub("", text) == text
        assert scannoise.may_break(text) or not any(scannoise._LAST.search(x) for x in text.replace("\r", "").split("\n")[:-1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aSIxvpagVol 12().,|-–éс", max_size=30))
def test_lines_with_features_may_be_furniture(line):
    paper = scannoise.Paper("Steady flow", ["B. Nobody"], "Annals of Flow", "10-20", 1999)
    assert scannoise.may_be_furniture(line, paper) or scannoise.line_features(line, None, None, 90, paper, [3]) is None


def test_texts_read_together_have_what_they_have_alone(monkeypatch):
    texts = ["wail 0.O5", "", "the “wail” of A-7 and fl0w", "a" * 40, "wail/wall", "x1y wall"]
    reader = scannoise.Reader({"wail": "wall"}, {}, None, None)
    whole = reader._looks(texts)
    assert {i: {w for x in found for w in x[0]} for i, found in whole.items()} == {0: {"wail"}, 2: {"wail"}, 4: {"wail"}, 5: set()}
    monkeypatch.setattr(scannoise, "TOGETHER", 12)
    assert [x for _, run in scannoise.together(texts) for x in run] == texts and [a for a, _ in scannoise.together(texts)] == [0, 2, 3, 4, 5]
    assert reader._looks(texts) == whole


def test_counts_are_those_of_whole_texts(spark):
    texts = ["wall bound-\nary 0.O5 A-7", "wall-\nand “wall” bound- \r\nary_x\twall/1.5", "pres=\n\nsure 12", "wall ﬁow co\xadre\u20031.5", "", "x-", "wall"]
    joined = "\n\n".join(map(scannoise.readable, texts))
    words = Counter(w for w in scannoise._WORD.findall(scannoise._BREAK.sub("", joined)) if not w.isdigit())
    shapes = Counter(map(scannoise.shape, scannoise._WITH_DIGIT.findall(joined))) + Counter(scannoise.shape(w) for w in words.elements())
    got = scannoise.word_counts(spark.createDataFrame([(t,) for t in [*texts, None]], "content string"))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in words.items() if len(w) >= 2} | {scannoise.SHAPE + w: n for w, n in shapes.items()}


def test_long_headers():
    journal = "Proceedings of the Streak Colloquium"
    title = "Steady flow over rough walls with slots of several widths that are closed one after the other at low speed"
    paper = scannoise.Paper(title, ["B. Nobody"], journal, "10-20", 1999)
    spaced = "  ".join(" ".join(w) for w in f"{journal}, Vol. 58, No. 6".split())
    lines = [spaced, title.upper()]
    assert all(len(x) > 90 for x in lines)
    text = "The wake of the plate was measured at\nthe lowest speed and near the wall of\nthe tunnel with a probe that had been\ncalibrated before and after the runs."
    reader = scannoise.Reader({}, {}, scannoise.train_lines([paper], [text]), scannoise.train_pairs([], {}.get))
    for line in lines:
        kinds, out = reader.read([f"{line}\n{text}"], [paper], [[3]], repair=True)[0]
        assert kinds == {"header"} and line not in out and "the runs." in out
    assert scannoise.line_features("a" * 200, None, None, 90, paper, []) is None


# --- 5 near duplicates


def test_near_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(35, 80))] for _ in range(60)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randrange(4)):
            c = b[:]
            for _ in range(rng.randrange(9)):
                c[rng.randrange(len(c))] = f"x{rng.randrange(500)}"
            rng.shuffle(c)
            texts.append(" ".join(c))
    texts += [texts[0]] * 70 + [None, "", "too short"]
    sets = [set(neardup._WORD.findall((t or "").lower())) for t in texts]
    want = {(f"{i:04}", f"{j:04}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if min(len(sets[i]), len(sets[j])) >= 30 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75}
    df = spark.createDataFrame([(f"{i:04}", t) for i, t in enumerate(texts)] + [("0001", texts[1])], "id string, text string").where("text is not null")
    for bucket in (64, 2):
        monkeypatch.setattr(neardup, "BUCKET", bucket)
        monkeypatch.setattr(neardup, "HOT", bucket)
        assert {tuple(r) for r in neardup.near_pairs(df).collect()} == want
    groups = {r.id: (r.class_id, r.n_links) for r in neardup.near_groups(df).collect()}
    links = Counter(x for p in want for x in p)
    assert all(groups[i][1] == links[i] for i in groups) and all(groups[a][0] == groups[b][0] for a, b in want)
    assert neardup.near_pairs(df.where("false")).count() == 0


def test_texts_on_one_subject_are_no_candidates(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(130)], 60)) for _ in range(300)]  # about 0.3 of the words of two are common
    df = spark.createDataFrame([(f"{i:04}", t) for i, t in enumerate(texts)], "id string, text string")
    assert neardup.candidate_pairs(neardup.prepared(df)[1]).count() < 200


# --- 6 splitting


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n。流", max_size=600), st.integers(5, 60), st.integers(0, 20))
def test_pieces_cover_the_text(text, most, overlap):
    text = text.strip()
    at, rank = splitting.boundaries(text, 0, len(text), 0)
    pieces = splitting.cut_points(at, rank, len(text), most, overlap)
    assert all(0 < e - s <= most for s, e in pieces)
    assert not text or (pieces[0][0] == 0 and pieces[-1][1] == len(text))
    assert all(s2 <= e1 and e1 - s2 <= overlap and e2 > e1 and s2 > s1 for (s1, e1), (s2, e2) in zip(pieces, pieces[1:]))


def test_split_items_by_ranges(spark, monkeypatch, tmp_path):
    rng = random.Random(2)
    text = " \n" + "".join(rng.choice(["word ", "end. ", "line\n", "para.\n\n", "流流。"]) for _ in range(900)) + "x" * 500 + "\n "
    items = spark.createDataFrame([("big", " PARAGRAPH", text, 1), ("big", " PARAGRAPH", text, 2), ("ok", "paragraph", "short", 1), ("n", None, text, 1), ("z", "paragraph", None, 1), ("o", "other", text, 1)], "chunk_id string, element_type string, content string, n int")
    limits = spark.createDataFrame([("paragraph", 120, 15)], "element_type string, max_chars int, overlap_chars int")
    whole = rows(splitting.split_items(items, limits).select("item", "piece", "start", "end", "text"))
    monkeypatch.setattr(splitting, "RANGE", 100)
    assert rows(splitting.split_items(items, limits).select("item", "piece", "start", "end", "text")) == whole
    core = text.strip(" \n")
    assert {r[0] for r in whole} == {"big"} and all(core[s:e] == t for _, _, s, e, t in whole) and len({r[1] for r in whole}) == len(whole)
    path = tmp_path / "f.txt"
    path.write_text(core, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    files = splitting.files_of(spark, f"file://{tmp_path}")
    got = sorted((r.piece, r.start, r.end) for r in splitting.split_files(files, 120, 15, 997).collect())
    assert got == [(p, s, e) for _, p, s, e, _ in whole]
    # With anchors in every third range the pieces still cover the file in order.
    got = sorted((r.piece, r.start, r.end) for r in splitting.split_files(files, 120, 15, 497, 3).collect())
    assert [g[0] for g in got] == list(range(len(got))) and got[0][1] == 0 and got[-1][2] == len(core)
    assert all(s2 <= e1 and e1 - s2 <= 15 and e2 - s2 <= 120 and e2 > e1 for (_, _, e1), (_, s2, e2) in zip(got, got[1:]))


def test_boundaries_after_many_blanks():
    text = "one.\n" + " " * 500 + "\n" + " " * 300 + "two"
    p = text.index("two")
    want = splitting.boundaries(text, 0, len(text), 0)
    assert want == ([p], [splitting.PARAGRAPH])
    for size in (1, 7, 100):
        got = ([], [])
        for lo in range(0, len(text), size):
            hi = min(len(text), lo + size)
            halo = splitting.halo_of(text, lo, hi)
            part = splitting.boundaries(text[lo - halo : hi], halo, halo + hi - lo, lo - halo)
            got = (got[0] + part[0], got[1] + part[1])
        assert got == want


# --- 7 encoding


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab '.\n1é流速ส🙂-", "<|endoftext|>", "the", "'s"]), max_size=200), st.integers(5, 40))
def test_encoding_in_parts_is_exact(chars, most):
    text = "".join(chars)
    enc = encoding.load()[0]
    assert encoding.encode_text(text, most=most) == (enc.encode_ordinary(text) if text else [])


@pytest.mark.parametrize("solo, group", [(1 << 16, 512), (100, 3)])
def test_encode_corpus(spark, monkeypatch, solo, group):
    monkeypatch.setattr(encoding, "SOLO", solo)  # small: parts go through all tasks
    monkeypatch.setattr(encoding, "GROUP", group)
    long = "流速测量" * 3000 + " and then " + "x" * 5000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a <|endoftext|> b", 0), (4, long, 0)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df.unionByName(df)).collect()}
    assert encoding.encode_corpus(df.unionByName(df)).count() == 8 and all(len(x) < 600 for x in encoding.halves(long))
    enc, of = encoding.load()
    assert got[1] == got[2] == [] and got[3] == enc.encode_ordinary("a <|endoftext|> b") and got[4] == enc.encode_ordinary(long)
    assert b"".join(of[i] for i in got[4]).decode() == long


# --- 8 mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 80))
def test_sainte_lague_equals_one_by_one(sources, seats):
    w, stock = {i: a for i, (a, _) in enumerate(sources)}, {i: b for i, (_, b) in enumerate(sources)}
    want = {i: 0 for i in w}
    for _ in range(min(seats, sum(stock.values()))):
        k = max((i for i in w if want[i] < stock[i]), key=lambda i: (w[i] / (2 * want[i] + 1), -i))
        want[k] += 1
    assert mixing.sainte_lague(w, stock, seats) == want


def test_mix(spark):
    docs = [(i, "big" if i % 3 else "small", "some words about a flow " * (i % 5 + 1)) for i in range(600)] + [(1000, None, "x"), (1001, "big", None), (1002, "other", "y")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(d, t, total_tokens=5000, block_tokens=64)
    r = {x.source: x for x in report.collect()}
    assert r["gone"].taken_tokens == 0 and abs(r["big"].actual_share - 5 / 9) < 0.02 and abs(r["small"].actual_share - 4 / 9) < 0.02
    assert selection.where("source = 'big' and copies > 1 or copies > 2").count() == 0
    assert rows(selection) == rows(mixing.mix(d, t, total_tokens=5000, block_tokens=64)[0])
    assert mixing.mix(d.where("false"), t)[0].count() == 0


# --- 9 sentences


def test_sentences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = [(-1, "Title here\n\nDr. Mirnenell fitted the plate. It reached 5.3 percent."), (-2, None), (-3, " \n"), (-4, "前缘限制了厚度。“流动仍是层流吗？”审稿人问道。"), (-5, "​")]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in both.collect()}
    found = {}
    for r in sentences.sentence_spans(both).collect():
        found.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    assert [texts[-1][s:e] for s, e in sorted(found[-1])] == ["Title here", "Dr. Mirnenell fitted the plate.", "It reached 5.3 percent."]
    assert [texts[-4][s:e] for s, e in sorted(found[-4])] == ["前缘限制了厚度。", "“流动仍是层流吗？”审稿人问道。"]
    assert not {-2, -3, -5} & set(found)
    for i, spans in found.items():
        t, at = texts[i], 0
        for s, e in sorted(spans):
            assert s >= at and t[at:s].strip(" \t\r\n") == "" and t[s:e] == t[s:e].strip(" \t\r\n") != ""
            at = e
        assert t[at:].strip(" \t\r\n") == ""


def test_sentence_model_counts_all_texts(spark):
    rng = random.Random(4)
    ends = ["wall", "plate", "tunnel"]
    part = lambda: f"We saw Zqv. Halgor near the {rng.choice(ends)}. It held the {rng.choice(ends)}."
    long = "\n\n".join(part() for _ in range(400))  # the word is in this text only
    short = "The plate was moved by Zqv. Halgor on the next day. It held the wall."
    texts = [long, short, "Το πείραμα έγινε. Η ροή ήταν αργή.", "流动仍是层流。前缘限制了厚度。"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [texts[3]] * 50)], "doc_id bigint, text string")
    assert len(long) > 20_000
    got = {(r.sent_start, r.sent_end) for r in sentences.sentence_spans(docs).where("doc_id = 1").collect()}
    assert [short[s:e] for s, e in sorted(got)] == ["The plate was moved by Zqv. Halgor on the next day.", "It held the wall."]
    model = sentences.train(sentences.scanned(docs.select(F.col("doc_id").alias("id"), "text")))
    assert model.n3["Zqv", "."] == 401 and model.n3["流", "。"] + model.n3["层", "流"] <= 2  # each text once
    n = sum(len(sentences.words_of(t, 0, len(t))) for t in texts)
    assert model.plain.n1 - model.plain.c1[sentences.EDGE] == n


def test_stretches_hold_the_tokens_around_places():
    """Tokens found from a place on are those of tokenising the whole text."""
    text = "Dr. K-71 saw p. 5. Then “it held!” (cf. Fig. 3.5) and " + "verylongword" * 9 + ". No; ἔργον; 流れた。次は"
    every = [sentences._token(m) for m in sentences._TOKEN.finditer(text)]
    starts = {t[2]: i for i, t in enumerate(every)}
    for b in sentences.blocks(text):
        for p in b.places:
            i = starts[p.at]
            assert [p.u, p.v, *p.after] == every[i - 2 : i + 3] or i < 2
    assert sentences._WORDS.findall(text) == [m.group() for m in sentences._TOKEN.finditer(text) if m.lastgroup not in "tp"]


def test_unpunctuated_text_is_split(spark):
    rng = random.Random(5)
    nouns, verbs = "tunnel plate wall probe layer".split(), "held moved grew".split()
    one = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} near the {rng.choice(nouns)}"
    texts = [" ".join(one() + "." for _ in range(5)) for _ in range(200)] + ["The probe held near the wall The plate grew near the tunnel The wall moved near the probe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r.sent_start, r.sent_end) for r in sentences.sentence_spans(docs).where("doc_id = 200").collect())
    assert [texts[200][s:e] for s, e in got] == ["The probe held near the wall", "The plate grew near the tunnel", "The wall moved near the probe"]


def test_lost_signs_are_found_in_text_with_signs(spark):
    """Every position between two words is scored, not only those after a terminator."""
    rng = random.Random(6)
    nouns, verbs = "tunnel plate wall probe layer".split(), "held moved grew".split()
    one = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} near the {rng.choice(nouns)}"
    texts = [" ".join(one() + "." for _ in range(5)) + " (The probe was cold.)" * (i % 3 == 0) for i in range(200)]
    more = [
        "The probe held near the wall. The plate grew near the tunnel The wall moved near the probe. The layer held near the wall.",
        "The probe held near the wall. The plate grew near the tunnel (The probe was cold.) The layer held near the wall.",
        "The probe held near the wall. The wall moved “near the tunnel The plate grew” near the wall.",
    ]
    wanted = [
        ["The probe held near the wall.", "The plate grew near the tunnel", "The wall moved near the probe.", "The layer held near the wall."],
        ["The probe held near the wall.", "The plate grew near the tunnel", "(The probe was cold.)", "The layer held near the wall."],
        ["The probe held near the wall.", "The wall moved “near the tunnel The plate grew” near the wall."],
    ]
    docs = spark.createDataFrame(list(enumerate([*texts, *more])), "doc_id bigint, text string")
    got = {}
    for r in sentences.sentence_spans(docs).where("doc_id >= 200").collect():
        got.setdefault(r.doc_id - 200, []).append((r.sent_start, r.sent_end))
    for i, text in enumerate(more):
        assert [text[s:e] for s, e in sorted(got[i])] == wanted[i]


def test_posteriors_of_all_gaps():
    """The posteriors of many sentences at once are those of adding up all sets of events."""
    rng = random.Random(7)
    words, edge = "abcd", sentences.EDGE
    plain = sentences.Unpunctuated(set(words))
    for _ in range(60):
        s = [edge, *(rng.choice(words) for _ in range(rng.randrange(1, 5))), edge]
        for v, w in zip(s, s[1:]):
            plain.c2[v, w] += 1
            plain.n2[v] += 1
            plain.c1[w] += 1
        plain.c3[edge, s[1], s[2]] += 1
        plain.c3[(s[-3], s[-2], edge)] += s[-3] != edge
    plain.n1, plain.k1 = plain.c1.total(), len(plain.c1)
    plain.t2.update(v for v, _ in plain.c2)
    for (u, v, w), n in plain.c3.items():
        plain.n3[u, v] += n
        plain.t3[u, v] += 1
    texts = [" ".join(rng.choice(words + "x") for _ in range(n)) for n in (1, 2, 9, 5, 3, 1, 6)] + ["a b (c d a) b c", "a b. c d"]
    rows = [(t, *sentences.scan(t)[:4]) for t in texts]
    gaps = plain.read(rows, [[0] for _ in texts])
    got = iter(plain.boundaries(gaps).tolist())
    opened = plain.tables["opening"]
    for t, row in zip(texts, rows):
        tok = [plain.shape(x, "w") for x in t.replace(".", "").replace("(", "").replace(")", "").split()]
        share = [1.0] * (len(tok) - 1)
        if "(" in t:
            share = [1.0, opened, 0.0, 0.0, 1.0, 1.0]
        if "." in t:
            share = [sentences.LOST, 0.0, sentences.LOST]  # after the terminator the first model decides
        total, at = 0.0, [0.0] * len(share)
        for events in range(1 << len(share)):
            p, after = 1.0, True
            for i, x in enumerate(share):
                u, v, w = edge if after else tok[i - 1], tok[i], tok[i + 1]
                e = plain.edge(u, v)
                e = e * x / (e * x + 1 - e)
                start = plain.c2[edge, w] + plain.t2[edge] * (plain.c1[w] + 0.5) / (plain.n1 + 0.5 * (plain.k1 + 1))
                here = bool(events >> i & 1)
                p *= e * start / (plain.n2[edge] + plain.t2[edge]) if here else (1 - e) * (plain.p(edge, v, w) if after else plain._p2(v, w))
                after = here
            total += p
            at = [a + p * (events >> i & 1) for i, a in enumerate(at)]
        for a in at:
            assert next(got) == pytest.approx(a / total, rel=1e-4, abs=1e-9), t
    assert next(got, None) is None


def test_thai_blanks_are_decided_by_the_model(spark):
    docs = spark.createDataFrame([(i, f"การไหลแบบปั่นป่วน ผนังเรียบ {i} มม ท่อยาวมาก และ Tunnel นี้") for i in range(40)], "doc_id bigint, text string")
    t = {r.doc_id: r.text for r in docs.collect()}
    got = sorted((r.sent_start, r.sent_end) for r in sentences.sentence_spans(docs).where("doc_id = 7").collect())
    assert [t[7][s:e] for s, e in got] == ["การไหลแบบปั่นป่วน", "ผนังเรียบ 7 มม", "ท่อยาวมาก", "และ Tunnel นี้"]


# --- whole queries


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_queries_run(spark, name):
    assert q.queries()[name](spark, SF).count() >= 0
