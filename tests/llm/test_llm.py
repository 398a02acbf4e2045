"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from plotwise.llm import cotrain, graph, langid, lines, mixing, packing, quality_rules, shingles, simhash, suffix, tokens, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size int, _words string"


def sentences(rnd, n, pool=("the", "of", "ring", "stone", "water", "and", "light", "house", "river", "green", "naïve", "été", "x1", "don't", "A.", "B,")):
    return " ".join(rnd.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    base = [sentences(rnd, rnd.choice([5, 60, 200])) + "\n" + sentences(rnd, 30) + "\n" + sentences(rnd, 9) for _ in range(25)]
    texts = [rnd.choice(base) + rnd.choice(["", "", "\n" + sentences(rnd, 40), " end"]) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "two words", "a  b\n\n c\t d ", "<|endoftext|> hi <|endoftext|>", "x²½ª µ İstanbul ﬁ 你好  世界", "lorem ipsum dolor " * 8000, "!!! ### $$$ " * 30, "é" * 300]
    out = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "ü", "a"][i % 5], len(t or ""), i, "w") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[0], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_base_rules(docs, rows):
    def brute(text):
        words = WORD.findall(text or "")
        lines_ = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = collections.defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        hit = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(3)}
        n = len(words)
        return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines_) - len(set(lines_)), len(hit), n < 50 or 100 * len(hit) > 50 * n

    got = quality_rules.base_rules(docs).select("doc_id", *quality_rules.BASE).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r[0], *brute(r[1])) for r in rows)


def test_quality_rules(spark, docs, rows):
    rnd = random.Random(1)
    good = [(1000 + i, sentences(rnd, 80), None, "s", 1, 1, "") for i in range(40)]
    bad = [(2000 + i, " ".join(w.upper() + "!!" for w in sentences(rnd, 80).split()), None, "s", 1, 1, "") for i in range(20)]
    every = spark.createDataFrame(good + bad, SCHEMA).union(docs)
    out = quality_rules.quality_rules(every, spark.createDataFrame([(r[0],) for r in good[:20]] + [(None,)], "doc_id long"))
    kept = {r["doc_id"]: r["kept"] for r in out.where("doc_id >= 1000").collect()}
    assert all(kept[r[0]] for r in good) and not any(kept[r[0]] for r in bad)
    assert quality_rules.accepted(every, every.select("doc_id").limit(0)).columns == every.columns
    assert quality_rules.quality_rules(every.limit(0), every.select("doc_id")).count() == 0


def test_mixing(spark, docs, rows):
    got = mixing.mixing_plan(docs, narrow=True).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, rest, open_, target = dict(zip(order, [5, 2, 1] * 9)), 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s], rest = 2 * sizes[s], rest - 2 * sizes[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
    assert sum(r["copies"] for r in got) == mixing.mix_sources(docs).count()
    assert mixing.mix_sources(docs).columns == docs.columns
    assert mixing.mixing_plan(docs, narrow=True, most_broadcast=0).count() == len(rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def reachable(prints, radius):
    """Smallest id reachable from each place of a list of (id, fingerprint)."""
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if bin(a ^ b).count("1") <= radius and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(prints, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [least.get(g) for g in group]


def brute_print(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = collections.Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, reachable(prints, 2), strict=True))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    h = spark.createDataFrame([("the of ring",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest("the of ring", 42)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    assert {r[0] for r in one.where("doc_id is not null").collect()} == {c for c in reachable(prints, 2) if c is not None}


def test_no_near_pair_stays(spark, docs, rows):
    rnd = random.Random(12)
    pool = [f"w{i}" for i in range(3000)]
    base, chain = [[rnd.choice(pool) for _ in range(rnd.choice([60, 150, 400]))] for _ in range(30)], [rnd.choice(pool) for _ in range(150)]
    texts = []
    for words in [w for w in base for _ in range(3)] + [chain] * 20:
        words = list(words)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(pool)
        texts.append(" ".join(words))
    every = [*{r[0]: r for r in rows if r[0] is not None}.values(), rows[-1], *[(800 + i, t, None, None, 0, 0, "") for i, t in enumerate(texts)]]
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [(r[1] or "").encode().lower().split()] if w for i in range(max(1, len(w) - 4))} for r in every if r[0] is not None}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    got = shingles.without_near(spark.createDataFrame(every, SCHEMA).repartition(4), reps=1)
    assert got.columns == docs.columns
    stay = {r["doc_id"] for r in got.collect()}
    assert None in stay and not any(like(a, b) for a in stay - {None} for b in stay - {None} if a < b)
    assert all(any(like(a, b) for b in sets if b < a) for a in sets if a not in stay)
    assert {a for a in sets if not any(like(a, b) for b in sets if a != b)} <= stay
    # SimHash at two bits leaves near pairs behind
    one = simhash.one_of_each(spark.createDataFrame(every, SCHEMA))
    left = {r["doc_id"] for r in one.collect()} - {None}
    assert any(like(a, b) for a in left for b in left if a < b)
    assert shingles.without_near(docs.limit(0)).count() == 0


def test_texts_with_a_common_passage_are_few_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = word(100)
    texts = [" ".join(passage + word(26)) for _ in range(60)]
    texts += [texts[50] + " end", *[" ".join(passage[:k] + word(12) + passage[k + 12 :]) for k in (20, 60)]]
    pairs = []
    kept = shingles.written
    monkeypatch.setattr(shingles, "written", lambda df, name: pairs.append(kept(df, name).count()) or kept(df, name) if name == "near-pairs" else kept(df, name))
    stay = {r[0] for r in shingles.without_near(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert stay == set(range(63)) - {60}
    assert sum(pairs[1:]) < 100 and sum(pairs) < 500  # 1,953 pairs share the passage


def test_few_ids_move_no_text(spark, docs, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = {f: f(docs) for f in (lines.passage_dedup, simhash.one_of_each)}
        near = shingles.without_near(docs.where("doc_id < 60").dropDuplicates(["doc_id"]))
        for df in (*one.values(), near):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
        for f, df in one.items():
            assert sorted(map(str, f(docs, most_broadcast=0).collect())) == sorted(map(str, df.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ball_links_connect_all(spark):
    rnd = random.Random(2)
    prints = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        p = rnd.choice(prints)
        for _ in range(rnd.randrange(4)):
            p ^= 1 << rnd.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = {r["node"]: r["root"] for r in graph.components(simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    groups = reachable(list(enumerate(prints)), 2)
    got = collections.defaultdict(set)
    for i, p in enumerate(signed):
        got[roots.get(p, p)].add(i)
    want = collections.defaultdict(set)
    for i, g in enumerate(groups):
        want[g].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_and_a_star(spark):
    path, star = [(i, i + 1) for i in range(40)], [(100, 101 + i) for i in range(300)]
    links = spark.createDataFrame([*path, *star, (7, 7), (None, 3), (5, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 401), 100)}


def test_topk(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(300, 8)).astype(np.float32)
    vectors[100:200] = vectors[100]
    data = [(i, [float(v) for v in x], 1) for i, x in enumerate(vectors)]
    data += [(None, [1.0] * 8, 1), (400, None, 1), (420, [1.0, None] + [0.0] * 6, 1), (440, [float("nan")] * 8, 1), (460, [float("inf")] * 8, 1), (40, [0.5] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4)
    good = [(i, np.floor(64 * np.array(x, np.float64)).astype(int)) for i, x, _ in data if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    want = collections.Counter()
    for n, (q, x) in enumerate(good):
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for m, (i, y) in enumerate(good) if m != n)[:20]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    for options in ({}, {"block_rows": 37, "fan_in": 2}):
        assert collections.Counter(map(tuple, topk.exact_top_k(df, **options).collect())) == want
    assert topk.exact_top_k(df.limit(0)).count() == 0 and topk.exact_top_k(df.where("vec_id = 20")).count() == 0


def brute_spans(rows, length=50):
    first, out = {}, []
    ids = [suffix.NO_ID if r[0] is None else r[0] for r in rows]
    texts = [(r[1] or "").encode() for r in rows]
    for k, b in zip(ids, texts, strict=True):
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            first[w] = min(first.get(w, k), k)
    for r, k, b in zip(rows, ids, texts, strict=True):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < k:
                gone[j : j + length] = b"\1" * length
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        out.append((r[0], len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return collections.Counter(out)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "part_bytes": 5000}, {"block_bytes": 3000, "part_bytes": 5000, "common_blocks": 1}])
def test_suffix(spark, rows, options):
    some = [r for r in rows if len(r[1] or "") < 5000] + [(500, "a" * 400, *[None] * 5), (501, "a" * 120 + "b", *[None] * 5)]
    got = suffix.repeated_spans(spark.createDataFrame(some, SCHEMA).repartition(4), **options).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in got) == brute_spans(some)


def test_suffix_grown_parts(spark, rows):
    some = [r for r in rows if len(r[1] or "") < 5000] + [(500, "ab" * 200, *[None] * 5), (501, "", *[None] * 5), (502, "ab" * 90 + "c", *[None] * 5)]
    got = suffix.repeated_spans(spark.createDataFrame(some, SCHEMA).repartition(4), block_bytes=3000, part_bytes=700, many_parts=3).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in got) == brute_spans(some)


def test_suffix_rows_grow_slowly():
    # a block sends a row a part
    assert suffix.parts_of(900 << 20, 6 << 20, 512) == (150, 16) and suffix.parts_of(10 << 30, 6 << 20, 512)[0] == 512
    parts, subs = suffix.parts_of(1 << 40, 6 << 20, 512)
    assert parts * (24 << 20) >= 1 << 40 and subs <= 256


def test_suffix_of_nothing(docs):
    assert suffix.repeated_spans(docs.limit(0)).count() == 0


def test_refined_buckets():
    data = np.frombuffer(b"abababab" * 20 + b"xyz" * 30 + b"abab", np.uint8)
    got = suffix.refined(data, 11)
    windows = [data[i : i + 11].tobytes() for i in range(len(data) - 10)]
    assert len(set(zip(got.tolist(), windows))) == len(set(windows)) == len(set(got[: len(windows)].tolist()))


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    want = collections.Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows)
    assert collections.Counter(map(tuple, tokens.count_tokens(docs, BYTE).collect())) == want
    assert tokens.count_tokens(docs.limit(0), BYTE).count() == 0


def test_whole_tokens_are_proved():
    from tokenizers import Tokenizer

    library, whole = Tokenizer.from_file(BYTE), tokens.whole_tokens(open(BYTE, encoding="utf-8").read())
    assert len(whole) > 40_000
    for t in random.Random(0).sample(sorted(whole), 300):
        assert len(library.encode(t, add_special_tokens=False).ids) == 1


def chunks(text):
    ls = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
    out, start = [], 0
    for i in range(len(ls)):
        if ((h[i - 1] if i else 0) * 31 + h[i]) % 3 == 0 or i == len(ls) - 1:
            out.append(ls[start : i + 1])
            start = i + 1
    return out


def test_line_dedup(spark, docs, rows):
    rnd = random.Random(9)
    pool = [sentences(rnd, 6) for _ in range(12)] + ["", " "]
    more = [(600 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 30))), None, None, 0, 0, "") for i in range(60)]
    every, seen, gone = [*rows, *more], {}, set()
    identity = {((r[0] is None, r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest(), r[1]) for r in every if r[1] is not None}
    for who, md5, text in sorted(identity):
        for k, c in enumerate(chunks(text)):
            if len(c) > 1 and WORD.search("\n".join(c)) and seen.setdefault("\n".join(c), (who, md5, k)) != (who, md5, k):
                gone.add((who, md5, k))
    want = collections.Counter()
    for r in every:
        key = ((r[0] is None, r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest())
        parts = [] if r[1] is None else chunks(r[1])
        stay = [c for k, c in enumerate(parts) if (*key, k) not in gone]
        text = None if r[1] is None else "\n".join("\n".join(c) for c in stay)
        want[(r[0], text, sum(map(len, parts)), sum(map(len, parts)) - sum(map(len, stay)), len(parts) - len(stay))] += 1
    got = lines.line_dedup(spark.createDataFrame(every, SCHEMA).repartition(4))
    assert collections.Counter(map(tuple, got.select("doc_id", "text", *lines.ADDED).collect())) == want
    assert got.where("n_removed_lines > 0 and n_chars <> length(text)").count() == 0
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_repeated_passages_go_whole(spark, docs, rows):
    rnd = random.Random(11)
    own = lambda: sentences(rnd, 6) + f" {rnd.random()}"
    passages = [[own() for _ in range(rnd.randrange(2, 9))] for _ in range(6)]
    texts = [[own(), *rnd.choice(passages), own(), *rnd.choice(passages)] for _ in range(40)] + [["a", "a", "a", "a"], ["", "", "b", "", "", "b"], ["", " ", "", " "]]
    every = [*rows, *[(700 + i, "\n".join(t), None, None, 0, 0, "") for i, t in enumerate(texts)]]
    identity = {((r[0] is None, r[0] or 0), hashlib.md5(r[1].encode()).hexdigest(), r[1]) for r in every if r[1] is not None}
    seen, gone = {}, collections.defaultdict(set)
    for who, md5, text in sorted(identity):
        parts = text.split("\n")
        for k, pair in enumerate(zip(parts, parts[1:])):
            if WORD.search(" ".join(pair)):
                first = seen.setdefault(pair, (who, md5, k))
                if first != (who, md5, k):
                    gone[who, md5] |= {k + 1} if first == (who, md5, k - 1) else {k, k + 1}
    want = collections.Counter()
    for r in every:
        lost = gone[(r[0] is None, r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()]
        text = None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in lost)
        want[(r[0], text, *r[2:4], len(text) if lost else r[4], *r[5:])] += 1
    got = lines.passage_dedup(spark.createDataFrame(every, SCHEMA).repartition(4))
    assert got.columns == docs.columns and collections.Counter(map(tuple, got.collect())) == want
    left = collections.Counter(x for r in got.where("doc_id >= 700").collect() for x in r["text"].split("\n"))
    assert {left[x] for p in passages for x in p} <= {0, 1}
    assert lines.passage_dedup(docs.limit(0)).count() == 0


def test_pipeline_takes_chunks_and_what_their_borders_cut(spark, monkeypatch):
    import corpus_pipeline

    run, rnd = [f"the line {i}" for i in range(12)], random.Random(4)
    rows = [(i, "\n".join([f"own {i} {rnd.random()}", *run[i % 4 : 12 - i % 3], f"end {i} {rnd.random()}"]), i) for i in range(8)]
    rows += [(20, "\n".join([*run, "", "", "last"]), 0), (21, "\n".join(["", "", "last"]), 1), (22, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    found = []
    monkeypatch.setattr(lines, "repeated_chunks", lambda *a, f=lines.repeated_chunks: found.append(f(*a)) or found[-1])
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    whole, pairs = ({r["doc_id"]: r["text"] for r in f(df).collect()} for f in (lines.line_dedup, lines.passage_dedup))
    assert len(found) >= 1 and {i: r["n_lines"] for i, r in got.items()} == {r[0]: r[2] for r in rows}
    for i, text, _ in rows[:-1]:
        left = got[i]["text"].split("\n")
        assert all(left.count(x) <= min(other[i].split("\n").count(x) for other in (whole, pairs)) for x in set(left))
        assert any(got[j]["text"] is not None and x in got[j]["text"].split("\n") for x in text.split("\n") for j in got)
    assert {x for r in got.values() if r["text"] for x in r["text"].split("\n")} >= {x for _, t, _ in rows if t for x in t.split("\n")} - {""}
    assert got[22]["text"] is None


@pytest.mark.parametrize("options", [{}, {"window": 64, "quantum": 16, "block_tokens": 500}, {"most_broadcast": 0}])
def test_packing(docs, rows, options):
    from tokenizers import Tokenizer

    library, window = Tokenizer.from_file(WORDS), options.get("window", 2048)
    ids = [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
    got = packing.pack(docs, WORDS, **options).collect()
    fill = collections.defaultdict(list)
    for p in got:
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
    for s, parts in fill.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or s == max(fill)
    assert sorted(fill) == list(range(max(fill) + 1))
    # each document's ids, with repeated rows as documents of their own
    want, have = collections.Counter(), collections.Counter()
    for r, x in zip(rows, ids, strict=True):
        want[(r[0], len(x))] += len(x)
    places = collections.defaultdict(list)
    for p in got:
        have[(p["doc_id"], p["doc_tokens"])] += p["length"]
        places[(p["doc_id"], p["doc_tokens"])].append((p["start"], p["length"], p["ids_crc32"]))
    assert have == want
    for r, x in zip(rows, ids, strict=True):
        for start, n, crc in places[(r[0], len(x))]:
            assert any(zlib.crc32(y[start : start + n].tobytes()) == crc for q, y in zip(rows, ids, strict=True) if q[0] == r[0] and len(y) == len(x))
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_packing_takes_the_ids_of_all_letters(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    letters = [c for c in map(chr, range(0x80, 0x2E80)) if c.isalpha()]
    texts = [f"ab{c}cd {''.join(letters[i : i + 3])}'s" for i, c in enumerate(letters)]
    got = packing.pack(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string"), WORDS, window=1 << 20)
    crc = lambda text: zlib.crc32(np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert {r["doc_id"]: r["ids_crc32"] for r in got.collect()} == {i: crc(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("run_bytes", [1, 300, 1 << 20])
def test_ids_of_runs(rows, run_bytes):
    import pyarrow as pa

    rnd = random.Random(9)
    odd = ["".join(rnd.choices(" \n\t''''sstremlvd0₂²ÀÉéßƐɛȺİſ!?-€<|", k=rnd.randint(0, 40))) for _ in range(2000)]
    texts = [r[1] for r in rows] + odd + ["!'s 're'll 'S don'T", "hi <|endoftext|>", None]
    known = tokens.Ids(tokens.word_bpe_file(WORDS), run_bytes)
    want = [np.array(known.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(known.of(pa.array(texts))) == want
    assert list(known.of(pa.array([], pa.string()))) == []


def test_round_robin_mixes(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, sentences(rnd, 60), None, "a" if i % 4 else "b", 0, 0, "") for i in range(400)], SCHEMA)
    got = packing.pack(df, WORDS, window=1024, quantum=64).join(df.select("doc_id", "source"), "doc_id")
    shares = got.groupBy("sequence_id").agg((F.sum(F.when(F.col("source") == "b", F.col("length"))) / F.sum("length")).alias("b")).orderBy("sequence_id").collect()
    assert all(abs(r["b"] - 0.25) < 0.15 for r in shares[:-2])


def test_language(spark, docs, rows):
    rnd = random.Random(5)
    pools = {"en": ("the", "house", "water", "with", "which", "stone"), "fr": ("le", "maison", "eau", "avec", "qui", "pierre"), "de": ("das", "haus", "wasser", "mit", "welche", "stein")}
    data = [(i, sentences(rnd, 30, pools[g := ("en", "fr", "de")[i % 3]]), g, g, 0, 0, "") for i in range(300)]
    odd = [(900, None, None, None, 0, 0, ""), (901, "12 !!", None, None, 0, 0, ""), (None, "the house", "xx", None, 0, 0, "")]
    got = langid.identify(spark.createDataFrame(data + odd, SCHEMA)).collect()
    said = {r["doc_id"]: r for r in got}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert held and all(said[d[0]]["held_out"] and said[d[0]]["lang_pred"] == d[2] for d in held)
    assert [said[i]["lang_pred"] for i in (900, 901)] == ["und", "und"] and said[900]["score"] == 0.0
    mixed = spark.createDataFrame([(902, sentences(rnd, 60, pools["fr"]) + " " + sentences(rnd, 40, pools["de"]), None, None, 0, 0, "")], SCHEMA)
    r = langid.identify(spark.createDataFrame(data, SCHEMA).union(mixed)).where("doc_id = 902").first()
    assert r["lang_pred"] == "fr" and 0.5 < r["score"] < 0.7
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(rows) and {r["lang_pred"] for r in none} == {"und"}


def test_classifier(spark, docs, rows):
    rnd = random.Random(6)
    bad = lambda: " ".join(w.upper() + "!!" for w in sentences(rnd, 60).split())
    data = [(i, sentences(rnd, 60) if i % 3 else bad(), None, "s", 100, 0, "") for i in range(300)]
    df, labels = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.quality(df, labels).collect()
    assert len(got) == 300 and all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
    assert {r["quality"] for r in cotrain.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert cotrain.quality(docs, labels).count() == len(rows)


def test_word_shapes():
    def brute(word):
        kinds = [0 if "A" <= c <= "Z" or c in "ÀÉÖØÞ" else 1 if c.isalpha() else 2 if c.isdecimal() else c for c in word]
        return [k for i, k in enumerate(kinds) if not i or k != kinds[i - 1] or k not in (0, 1, 2)]

    words = ["HELLO", "Hello", "hello", "WORLD", "World", "x1", "y22", "A.B", "É.Ö", "naïve", "été", "don't", "12", "3,4", "--", "-", "z" * 1000, "Z" * 1000, "ÀB9é"]
    known = cotrain.WordFeatures()
    shapes = {w: known[w] >> 32 for w in words}
    assert {w: [shapes[w] == shapes[v] for v in words] for w in words} == {w: [brute(w) == brute(v) for v in words] for w in words}
    assert known["Hello"] & 0xFFFFFFFF == known["hello"] & 0xFFFFFFFF and known["Hello"] == cotrain.WordFeatures()["Hello"]
