"""The corpus operators against brute force, on small rows that hold the awkward cases."""

import collections
import hashlib
import math
import os
import random
import resource
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from draftlens.llm import common, html_text, jaccard, langid, mixing, neighbours, ngram, packing, quality, simhash, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"
WORDS = ["alpha", "beta,", "the", "of", "and", "gamma", "delta.", "épsilon", "zeta", "eta", "theta", "iota"]


def make_rows(seed=5, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(30))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(rng.choice([1, 3, 20, 60])))
        if i % 5 == 0:
            text = passage
        elif i % 5 == 1:
            text = f"{text} {passage} {text[:20]}"
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "x"), (n + 4, "a " * 300), (n + 5, "a " * 300), (n + 6, "!" * 250), (n + 7, "long " * 5000), (None, "no id at all"), (n + 8, "\n\n"), (n + 9, "ÀÉ ÀÉ àé")]
    return [(i, t, ["en", "de", None][(i or 0) % 3], ["s1", "S0", None, "s2"][(i or 0) % 4], len(t or ""), "clash", 1) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


MESSY = "`doc_id` long, text string, source string, `a.b` int, _doc int, row string, c0 int, score int, _words int, _lines int, lang string, n_chars long"


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    """Null and repeated ids, equal rows, and columns with awkward names, in files."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    p, many = some(400), " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(70))
    texts = [(1, p), (None, p + some(50)), (None, some(600)), (None, some(30) + p), (2, p), (8, some(600)), (8, some(100) + p), (8, many), (9, many), (9, many), (9, many), (None, many), (None, many), (3, None), (None, None), (3, ""), (4, "x" * 250), (4, "x" * 250)]
    texts += [(None, some(250)) for _ in range(6)] + [(20, "a b c d e f"), (20, "g h i")]
    rows = [(i, t, ["s", None, "t"][k % 3], k, k, "r", k, k, k, k, "en", len(t or "")) for k, (i, t) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("messy") / "t")
    spark.createDataFrame(rows, MESSY).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def in_key_order(df):
    """Rows (doc_id, text, position in docs) in the order of ids and row keys."""
    got = common.numbered(df).collect()
    return sorted(got, key=lambda r: (r.c0 is None, r.c0 or 0, r.row))


def words_of(text):
    return (text or "").encode().lower().split()


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- op10 ---------------------------------------------------------------------------------------


def fingerprint(text):
    w = words_of(text)
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [1024, 1])
def test_simhash(docs, rows, block):
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, block=block).collect()]
    fps = {r[0]: fingerprint(r[1]) for r in rows}
    assert sorted((i or -1, f) for i, f, _ in got) == sorted((i or -1, f) for i, f in fps.items())
    ids = sorted(i for i in fps if i is not None)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: c for i, _, c in got} == root | {None: None}


def test_simhash_links_of_a_chain(spark):
    rng = np.random.default_rng(1)
    f, out = int(rng.integers(1 << 62)), []
    for i in range(40):
        out.append((i * 3 % 41, f - (1 << 64) if f >> 63 else f))
        for b in rng.choice(64, 3, replace=False):
            f ^= 1 << int(b)
    nodes = spark.createDataFrame(out, "node long, fp long")
    got = simhash.components(simhash.links(nodes, 3, 4)).collect()
    assert len(got) == 39 and {r.root for r in got} == {0}


def test_rows_without_id_are_bridges(spark, monkeypatch):
    made = spark.createDataFrame([(7, 0), (None, 0b111), (3, 0b111111), (None, 1 << 40 | 1 << 45 | 1 << 50 | 1 << 55), (9, 0xFFFF << 44)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: made)
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(made).collect()) == ["3", "3", "3", "9", "None"]


def test_sets_keep_few_files_open(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(i, f"a{i // 2} b c d e f g h") for i in range(120)], "doc_id long, text string").repartition(60)
    texts.write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(jaccard.Sets, "OPEN", 2)
    read = jaccard.Sets("file:///nowhere")
    opened = []
    monkeypatch.setattr(read, "store", type("S", (), {"open_input_file": lambda self, p: opened.append(p) or pa.BufferReader(bytes(80))})())
    for number in (1, 2, 3, 1, 1, 3):
        read.read(number << 40 | 1, 4)
    assert len(read.files) == 2 and len(opened) == 4
    found = jaccard.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 for i in range(120)}


def test_simhash_keeps_one(docs, empty, rows):
    kept = [r.doc_id for r in simhash.deduplicated(docs.unionByName(docs.filter("doc_id = 3"))).collect()]
    assert len(kept) == len(set(kept)) and None in kept and 0 in kept and 5 not in kept
    assert simhash.deduplicated(empty).count() == 0


# --- near duplicates of the pipeline ---------------------------------------------------------------


@pytest.mark.parametrize("most", [32, 2])
def test_near_duplicates_are_exact(spark, docs, empty, rows, most):
    import corpus_pipeline

    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) for n in (40, 80, 80, 200)]
    extra = []
    for i in range(160):
        w = base[i % 4].split()
        for _ in range(rng.randint(0, len(w) // 40 + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        extra.append((1000 - i, " ".join(w[: len(w) - rng.randint(0, len(w) // 12)])))
    all_rows = [(r[0], r[1]) for r in rows] + extra
    sets = {}
    for i, text in all_rows:
        if i is not None:
            w = words_of(text)
            sets[i] = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                pairs += sets[a] != sets[b]
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert pairs > 100
    table = docs.unionByName(spark.createDataFrame([(i, x, None, None, 0, "", 1) for i, x in extra], SCHEMA))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(table, most=most).collect()}
    assert got == {i: find(i) for i in ids} | {None: None}
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(got.values()) - {None}) and None in kept
    assert jaccard.near_duplicates(empty).count() == 0


# --- op3 ----------------------------------------------------------------------------------------


def removed_bytes(rows, length):
    first, out = set(), {}
    for i, text in sorted(((r[0] if r[0] is not None else 1 << 62, r[1]) for r in rows), key=lambda x: x[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in first:
                gone[p : p + length] = True
            first.add(b[p : p + length])
        out[i if i < 1 << 62 else None] = (b, gone)
    return out


@pytest.mark.parametrize("group", [512, 2])
def test_suffix_dedup(docs, rows, group):
    want = removed_bytes(rows, 100)
    got = suffix.dedup_report(docs, group=group).collect()
    assert len(got) == len(rows)
    for r in got:
        b, gone = want[r.doc_id]
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert sum(r.n_removed for r in got) > 1000


def test_suffix_dedup_texts(docs, empty, rows):
    got = {r.doc_id: r.text for r in suffix.deduplicated(docs).collect()}
    assert got[0] == rows[0][1] and 5 not in got and got[60] is None and got[61] == ""
    assert suffix.dedup_report(empty).count() == 0


@pytest.mark.parametrize("group", [512, 2])
def test_suffix_dedup_of_shared_ids(messy, group):
    rows = in_key_order(messy)
    want = removed_bytes([(k, r.c1) for k, r in enumerate(rows)], 100)
    wanted = collections.Counter()
    for k, r in enumerate(rows):
        b, gone = want[k]
        wanted[(r.c0, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.dedup_report(messy, group=group).collect())
    assert got == wanted
    assert sum(1 for (i, n, gone, _), c in wanted.items() if i is None and n == 600 and not gone) == 1
    out = suffix.deduplicated(messy, group=group)
    assert out.columns == messy.columns and out.dtypes == messy.dtypes
    texts = {k: np.frombuffer(b, np.uint8)[~gone].tobytes().decode() for k, (b, gone) in want.items()}
    assert collections.Counter(x.text for x in out.collect() if x.text) == collections.Counter(x for x in texts.values() if x)


def test_one_of_each_group_stays(spark, messy):
    for groups in (simhash.grouped, jaccard.grouped):
        out = simhash.deduplicated(messy, groups=groups)
        assert out.columns == messy.columns
        kept = out.collect()
        rows = in_key_order(messy)
        first = {}
        for r in rows:
            first.setdefault(" ".join(r.c1.split()) if r.c1 else "", r)
        # texts that differ by a repeated passage may link too; each text of its own stays
        own = {t for t in first if "w" in t or t in ("a b c d e f", "g h i", "x" * 250, "")}
        assert collections.Counter(k.text or "" for k in kept if (k.text or "") in own) == collections.Counter(own)
        assert {k.doc_id for k in kept if k.text and k.text.startswith("w")} == {8}


def test_mix_of_shared_ids(spark, messy):
    rows = spark.createDataFrame([(5, "one two three four five six seven", "u", "q")] * 4 + [(None, f"n{i} m", "u", "q") for i in range(9)], "doc_id long, text string, source string, `_copy.x` string")
    for table in (rows, messy):
        got = mixing.mixed(table).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r.source].append(r)
        for r in by.values():
            assert abs(sum(x.taken for x in r) - r[0].target) <= 0.5
        out = mixing.curriculum(table)
        assert out.columns == table.columns
        words = collections.Counter()
        for r in out.collect():
            words[r.source] += len(words_of(r.text))
        assert words == collections.Counter({k: sum(x.taken for x in r) for k, r in by.items()})


def test_packing_of_shared_ids(spark, messy, tmp_path):
    path = packing.public_tokenizer()
    got = packing.pack(messy, path, room=64).collect()
    docs = [(r.c0, r.c1) for r in in_key_order(messy)]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.piece == 0 for r in got) == len(docs)
    mixing.curriculum(messy).write.parquet(str(tmp_path / "mix"))
    mix = spark.read.parquet(str(tmp_path / "mix"))
    got = packing.pack(mix, path, room=64, ordered=True).collect()
    assert len({r.position for r in got}) == mix.count() and len({(r.position, r.piece) for r in got}) == len(got)
    first = {}
    for r in got:
        first[r.sequence_id] = min(first.get(r.sequence_id, r.position), r.position)
    assert sorted(first) == list(range(len(first))) and [first[i] for i in range(len(first))] == sorted(first.values())


def test_running_totals_of_one_hot_key(spark):
    df = common.stored(spark.range(300_000).select(F.lit(1).alias("g"), F.lit(7).alias("same"), F.col("id").alias("row")), "hot")
    got = common.running(df, ["g"], ["same", "row"], {"n": F.lit(1)}, 300_000)
    assert got.filter("n <> row").count() == 0 and got.count() == 300_000


def test_few_open_files(spark):
    """Files of sorted arrays are mapped a few at a time."""
    base = common.scratch(spark, "many")

    def run(batches):
        for batch in batches:
            out, parts = common.Writer(base), batch.column(0).to_pylist()
            rows = [out.put(np.arange(p, p + 3, dtype=np.uint64)) for p in parts]
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32())} | common.places(rows))

    got = spark.range(0, 600, 1, 300).select(F.col("id").cast("int")).mapInArrow(run, f"part int, {common.PLACE}").toPandas()
    files = common.Mapped(base, 600, *(got[c].to_numpy() for c in ("part", "file", "at", "size")))
    limit = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 100, limit[1]))
    try:
        for part, _, _ in files.runs(np.arange(600)):
            assert files.array(part, np.uint64).tolist() == [part, part + 1, part + 2]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limit)
    assert len(files.maps) <= files.OPEN


def test_two_stage_order():
    rng = random.Random(2)
    for alphabet in (b"ab", b"aab", bytes(range(97, 120))):
        data = np.frombuffer(bytes(rng.choice(alphabet) for _ in range(700)) + b"\xff" * 128, np.uint8)
        order = suffix.two_stage(data, np.ones(700, bool), 104)
        raw = data.tobytes()
        keys = [raw[i : i + 100] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(700)) and keys == sorted(keys)


# --- op7 ----------------------------------------------------------------------------------------


def test_language(spark, empty):
    rng = random.Random(1)
    parts = {"aa": ["th", "er", "ing", "on"], "bb": ["sch", "ung", "ei", "ch"], "cc": ["ción", "que", "ar", "os"]}
    text = lambda x, n: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(x := ["aa", "bb", "cc"][i % 3], 30), x) for i in range(150)] + [(200, None, "aa"), (201, "12 !?", "bb"), (202, "", None), (None, text("bb", 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:150]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (200, 201, 202, None)] == ["und", "und", "und", "bb"] and got[201].rejected
    m = model.models
    bits, n = m.bits(["thering", "schung"])
    assert n.tolist() == [8, 7] and bits[0].argmin() == 0 and bits[1].argmin() == 1
    assert langid.accepted(docs).count() == 151
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_models_are_kneser_ney():
    """Against dictionaries; and the probabilities after a context sum to one."""
    rng = random.Random(3)
    samples = {x: collections.Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(80)) for x, letters in (("aa", "abcé"), ("bb", "bcdd"))}
    order = 3
    model = langid.Models(samples, order)
    alphabet = {c for s in samples.values() for w in s for c in w} | {"\x03"}
    uniform = 1 / (len(alphabet) + 1)

    def probability(lang):
        count = [collections.Counter() for _ in range(order + 1)]
        before = [collections.defaultdict(set) for _ in range(order + 1)]
        for w, k in samples[lang].items():
            m = f"\x02{w}\x03"
            for n in range(1, order + 1):
                for e in range(max(1, n - 1), len(m)):
                    g = m[e - n + 1 : e + 1]
                    if n == order or n > 1 and e == n - 1:
                        count[n][g] += k
                    elif e >= n:
                        before[n][g].add(m[e - n])
        for n in range(1, order):
            count[n].update({g: len(x) for g, x in before[n].items()})

        def p(context, c):
            if len(context) >= order:
                context = context[1 - order :]
            n = len(context) + 1
            low = p(context[1:], c) if n > 1 else uniform
            seen = {g: k for g, k in count[n].items() if g[:-1] == context}
            if not seen:
                return low
            once, twice = (sum(k == i for k in count[n].values()) for i in (1, 2))
            d = once / (once + 2 * twice) if once and twice else 0.5
            total = sum(seen.values())
            return max(seen.get(context + c, 0) - d, 0) / total + d * len(seen) / total * low

        return p

    for i, lang in enumerate(("aa", "bb")):
        p = probability(lang)
        for context in ("\x02", "\x02a", "bc", "b", "zz"):
            assert math.isclose(sum(p(context, c) for c in alphabet) + p(context, "z"), 1.0, rel_tol=1e-9)
        for w in ("abc", "é", "ddc", "zab", "bcbcb"):
            m = f"\x02{w}\x03"
            want = -sum(math.log2(p(m[:e][-2:], m[e])) for e in range(1, len(m)))
            assert math.isclose(float(model.bits([w])[0][0][i]), want, rel_tol=1e-4), (lang, w)


# --- op5 ----------------------------------------------------------------------------------------


def test_mixing(docs, empty, rows):
    got = mixing.mixed(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mixed(docs.repartition(5)).collect()}
    assert len(got) == len(rows) and {(r.doc_id, r.taken) for r in got} == again
    size = {r[0]: len(words_of(r[1])) for r in rows}
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for r in by.values():
        assert abs(sum(x.taken for x in r) - r[0].target) <= 0.5 and r[0].target <= 2 * r[0].source_size
    assert abs(sum(r[0].target for r in by.values()) - 1.5 * sum(size.values())) < 1
    copies = mixing.curriculum(docs).collect()
    assert sum(len(words_of(r.text)) for r in copies) == sum(r.taken for r in got)
    assert all((r.position is None) == (r.taken == 0) and 0 <= (r.position or 0) <= 1 for r in got)
    assert mixing.mixed(empty).count() == 0 and mixing.curriculum(empty).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("b", 10), (None, 1000), ("a", 1000)], "source string, n long").withColumn("none", F.col("source").isNull())
    assert {r.source: r.target for r in mixing.targets(sizes).collect()} == {"a": 1797.0, "b": 20.0, None: 1198.0}
    assert {r.target for r in mixing.targets(sizes, budget=9.0).collect()} == {20.0, 2000.0}


# --- op9 ----------------------------------------------------------------------------------------


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path, room=64).collect()
    ids = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    assert len(got) == sum(-(-len(x) // 64) for x in ids.values())
    at = collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.piece * 64 : (r.piece + 1) * 64]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * 64, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    free = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = min((f for f in free if f >= n), default=None)
        free.append(64 - n if fit is None else fit - n)
        if fit is not None:
            free.remove(fit)
    assert len(at) == len(free)
    assert packing.pack(empty, path).count() == 0


def test_word_parts_are_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    whole, parts = Tokenizer.from_file(path), packing._Parts(path)
    rng = random.Random(4)
    for _ in range(2000):
        s = "".join(rng.choice("aBé'sß½12!.-,ÀÿtT<|́\xa0日 ") for _ in range(rng.randint(0, 12)))
        for w in s.split(" "):
            assert np.frombuffer(parts[w], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids, w


# --- op4 ----------------------------------------------------------------------------------------


def test_quality(docs, empty, rows):
    got = {r.doc_id: r.measures for r in quality.measured(docs).collect()}
    for i, text, *_ in rows:
        w = words_of(text)
        win = [tuple(w0) for w0 in zip(*((text or "").encode().split()[k:] for k in range(5)), strict=False)]
        often = collections.Counter(win)
        covered = {p for k, x in enumerate(win) if often[x] > 1 for p in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        m = got[i]
        assert (m.n_words, m.word_chars, m.n_repeat_words, m.n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), len(covered), len(lines) - len(set(lines)))
    assert quality.filtered(empty).count() == 0 and set(quality.filtered(docs).columns) == set(docs.columns)


# --- op2 ----------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, " ".join([*(rng.choice(WORDS) for _ in range(20)), *((rng.choice(["grumblenaut", "snorkwad"]),) * 2 if bad else ())])))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "grumblenauts!")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (5, None), (6, 7), (None, 1)], "doc_id long, toxic int").filter("doc_id is null or doc_id % 5 > 0"))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all((got[i].score >= 0.5) == bool(y) for i, y in labels) and got[900].score == got[901].score < 0.5 and got[None].score >= 0.5 and got[None].evidence
    bag = dict(zip(*(x.tolist() for x in model.vector("grumblenaut snorkwad snorkwad")), strict=True))
    near, cosine = model.nearest(*model.vector("grumblenaut snorkwad snorkwad"))
    every = sorted(((-sum(bag.get(t, 0) * w for t, w in zip(*model.vector(text), strict=True)), i) for i, text in rows if i in model.ids))[: model.k]
    assert np.allclose(cosine, [-c for c, _ in every]) and len(near) == model.k
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_toxicity_by_brute_force():
    """Weights, cosines over whole bags, votes and scores against dictionaries."""
    rng = random.Random(16)
    vocabulary = [f"{rng.choice(['ba', 'ne', 'zu', 'ko'])}{rng.choice(['rt', 'lm', 'xx'])}{i}" for i in range(120)]
    text = lambda bad: " ".join([*rng.choices(vocabulary, k=rng.randint(1, 60)), *(rng.choices(["Vileword", "nastyish!"], k=2) if bad else [])])
    examples = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(150)]
    model = toxicity.Nearest(examples, share=0.1)
    whole = lambda w: w.lower().strip("!")
    bag = lambda t: collections.Counter(x for w in t.split() for x in ([whole(w), whole(w)[:6]] if len(whole(w)) > 6 else [whole(w)]))
    bags = [bag(t) for _, t, _ in examples]
    n, ones = len(bags), sum(y for *_, y in examples)

    def weight(term):
        k = sum(term in b for b in bags)
        a = sum(term in b for b, (*_, y) in zip(bags, examples, strict=True) if y)
        chi = n * (a * (n - ones - k + a) - (ones - a) * (k - a)) ** 2 / (ones * (n - ones) * k * (n - k)) if k < n else 0
        return (math.log((1 + n) / (1 + k)) + 1) * (toxicity.FLOOR + (1 - toxicity.FLOOR) * chi**2 / (chi**2 + toxicity.CHI**2))

    idf = {t: weight(t) for t in set().union(*bags)}

    def vector(bag):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in bag.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [vector(b) for b in bags]
    for t in [text(k % 2) for k in range(40)]:
        q = vector(bag(t))
        cosine = sorted((sum(x * v.get(k, 0) for k, x in q.items()) for v in vectors), reverse=True)[: model.k]
        i, got = model.nearest(*model.vector(t))
        assert np.allclose(got, cosine)
        votes = [((0.9 / (1 - ones / n), 0.1 / (ones / n))[int(model.labels[j])] / (toxicity.MARGIN + max(0, 1 - c)), model.labels[j]) for j, c in zip(i, got, strict=True)]
        p = (sum(w * y for w, y in votes) + 0.1) / (sum(w for w, _ in votes) + 1)
        assert math.isclose(model.score(t)[0], 1 / (1 + math.exp(-(model.a * math.log(p / (1 - p)) + model.b))), rel_tol=1e-6)
    assert model.score("")[0] == model.score(None)[0] == model.score("unknown")[0] == 0.1


def test_clashing_names(messy):
    names = messy.columns
    assert quality.measured(messy).columns == [*names, "measures"] and quality.measured(messy).select("_words", "`a.b`").first()[0] is not None
    assert quality.filtered(messy).columns == names
    out = toxicity.scored(messy, toxicity.Nearest([(1, "abc", 1), (2, "x", 0)]))
    assert out.columns == [*(n for n in names if n != "score"), "score", "evidence", "terms"] and out.select("score", "`a.b`").count() == messy.count()
    out = langid.identify(messy, langid.fit(messy))
    assert out.columns == [*(n for n in names if n != "score"), "lang_pred", "score", "entropy", "rejected"] and out.select("score").count() == messy.count()
    assert langid.accepted(messy).columns == names


def test_empty_tables(spark, empty):
    assert toxicity.scored(empty, toxicity.fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0 and langid.accepted(empty).count() == 0


# --- op6 ----------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[40:80] = x[40]
    rows = [(i, x[i].tolist(), 0) for i in range(120)] + [(200, None, 0), (220, [0.0] * 8, 0), (240, [1.0] * 7 + [float("nan")], 0), (260, [None] + [1.0] * 7, 0), (280, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (300, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in sorted(neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=5, block=32).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    for q in range(0, 120, 20):
        s = [(-float(np.add.accumulate(y[q] * y[i])[-1]), i) for i in range(120) if i != q]
        assert got[q] == [(i, -v) for v, i in sorted(s)[:5]]
    assert set(got) == set(range(0, 120, 20))


def test_neighbours_of_repeated_rows(spark):
    """25 equal rows of one id, and a query that is there twice, hide nobody."""
    rows = [(0, [1.0, 0.0])] * 25 + [(20, [1.0, 0.0])] * 2 + [(i, [1.0, 0.0]) for i in range(101, 110)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=8, block=64).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    assert got == {0: [20, 20, *range(101, 107)], 20: [0] * 8}


# --- op1 ----------------------------------------------------------------------------------------


def test_language_model(spark, docs, empty, rows):
    model = ngram.train(docs.filter("doc_id % 7 <> 2 or doc_id is null"))
    got = {r.doc_id: r for r in ngram.scored(docs, model).collect()}
    train = [words_of(r[1]) for r in rows if r[0] is None or r[0] % 7 != 2]
    end, start = object(), object()
    c, b = collections.Counter(), collections.Counter()
    for w in train:
        c.update([*w, end])
        b.update(zip([start, *w], [*w, end], strict=True))
    n, v = sum(c.values()), len(c)
    ctx, after = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (x, w), k in b.items():
        ctx[x][min(k, 3) - 1] += 1
        ctx[x][3] += k
        after[w] += 1
    d = (0.0, *model.pair_discounts)
    e = (0.0, *model.word_discounts)

    def p(x, w):
        low = max(after[w] - e[min(after[w], 3)], 0) / len(b) + model.rest / (v + 1)
        if x not in ctx:
            return low
        t = ctx[x]
        return sum(d[i + 1] * t[i] for i in range(3)) / t[3] * low + max(b[(x, w)] - d[min(b[(x, w)], 3)], 0) / t[3]

    for i, text, *_ in rows:
        w = words_of(text)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in [*w, end]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, end]), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(x, y)) for x, y in zip([start, *w], [*w, end], strict=True)), rel_tol=1e-7, abs_tol=1e-9)
    assert math.isclose(sum(p(b"the", w) for w in c) + p(b"the", b"unseen!"), 1.0, rel_tol=1e-6)
    assert ngram.scored(empty, model).count() == 0 and [r.score for r in ngram.scored(docs, ngram.train(empty)).limit(3).collect()] == [0.0] * 3


# --- op8 ----------------------------------------------------------------------------------------

PAGES = {
    "": "", "<p>x": "x", "only &amp; inline<br>text": "only & inline text", "<script>x</script>": "",
    "<nav>menu</nav><article><h1>T</h1><p><b>One, two<br><p>Three&nbsp; four</p></article><footer>f": "T\nOne, two\nThree four",
    '<div class="post-comments"><p>bad, bad, bad</p></div><div id="content"><p>Good text, long enough to count, yes.<ul><li>a<li>b</ul></div><aside>no</aside>': "Good text, long enough to count, yes.\na\nb",
    "<article><section><p>Long, long text of a section, with commas.</section><section><p>Short</section></article><form>q</form>": "Long, long text of a section, with commas.\nShort",
    "<!-- <p>no</p> --><style>p{}</style><p>a &#228; &unknown; <i>b</i>c": "a ä &unknown; bc",
    '<p title="a>b">quoted': "quoted",
    "<body><form id=f action=x><div><input><p>All of the article, in a form, as some systems do it.</p><p>More of it, to read.</p></div></form></body>": "All of the article, in a form, as some systems do it.\nMore of it, to read.",
    "<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math>, as known, and so on.</p>": "Energy is E=m, as known, and so on.",
    "<body><div class=wrap><div class=c1><div><p>First half of the text, long enough, with commas, to count.</p></div></div><div class=c2><div><p>Second half of the text, long enough too, with commas, to count.</p></div></div></div></body>": "First half of the text, long enough, with commas, to count.\nSecond half of the text, long enough too, with commas, to count.",
    "<div><form><p>Your name, please</p><label>Mail</label></form><p>An article, which is longer than the form, and has its own paragraph.</p></div>": "An article, which is longer than the form, and has its own paragraph.",
}


def test_main_text(spark):
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text, page
    assert html_text.main_text(None) == "" and html_text.main_text("<div>" * 5000 + "deep, deep text") == "deep, deep text"
    df = spark.createDataFrame([(1, "u", None, 5), (2, "u", "<p>x", 5)], "page_id long, url string, html string, text int")
    assert {(r.page_id, r.text) for r in html_text.extracted(df).collect()} == {(1, ""), (2, "x")}


def test_pipeline_starts_from_fingerprints(spark, monkeypatch):
    """Links of fingerprints come first and are verified: texts of one fingerprint with unlike sets stay, near copies go."""
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"u{rng.randint(0, 10**6)}" for _ in range(400)]
    often = " ".join(["a b c"] * 400)  # three shingles outweigh all others in the fingerprint, but not in the set
    last = [*words[:-1], "other"]
    rows = [(1, f"{often} {' '.join(words[:8])}"), (2, f"{often} {' '.join(words[8:16])}"), (3, " ".join(words)), (4, " ".join(last)), (5, "nothing like these at all in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(df).collect()}
    assert fps[1] == fps[2] and (fps[3] ^ fps[4]).bit_count() <= 3
    found, of = [], jaccard.fingerprinted
    monkeypatch.setattr(jaccard, "fingerprinted", lambda *a: (found.append(of(*a)), found[-1])[1])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 2, 3, 5]
    assert len(found) == 1 and found[0].count() == 1


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = make_rows(9, 80)
    folder = tmp_path / "sf"
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(folder / "documents.parquet"))
    out = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{i}")
        before = out
        stage(spark, before, str(folder)).write.parquet(path)
        out = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


# --- op2: whole words ------------------------------------------------------------------------------


def test_toxicity_reads_whole_words_and_scripts_without_spaces():
    assert toxicity.terms_of("internationale_Idiot_x") == ["internationale", "intern", "idiot", "x"]
    assert toxicity.terms_of("你是白痴abc") == ["你是", "是白", "白痴", "abc"] and toxicity.terms_of("痴") == ["痴"]


def test_toxicity_scores_follow_late_letters(spark):
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choice(WORDS) for _ in range(12))
    rows = [(i, plain() + (" internationalscum 你是白痴吗" if i % 2 else " internationalhouse 你是朋友吗")) for i in range(300)]
    rows += [(1000, "some internationalscum here"), (1001, "some internationalhouse here"), (1002, "你是白痴吗"), (1003, "你是朋友吗")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).filter("doc_id >= 1000").collect()}
    assert got[1000] > 0.5 > got[1001] and got[1002] > 0.5 > got[1003]


# --- op8: names inside an article, long broken pages -------------------------------------------------


def test_names_inside_an_article_are_no_verdict():
    body = "<p>The first paragraph of the article, which is long enough, with commas, to count.</p><p>And the second one, which is about as long, and says more.</p>"
    for name in ("article-header", "post-header", "social-history", "important-notice-of-law"):
        for tag in ("article", "main"):
            page = f'<body><nav>Menu</nav><{tag}><div class="{name}"><h1>Head</h1><p>Lede of it.</p></div>{body}<div class="comment-list">Me too</div><div class="ad">Buy</div><div class="share-tools"><a>Share</a> <a>Mail</a></div></{tag}><footer>Foot</footer></body>'
            got = html_text.main_text(page).split("\n")
            assert got[:2] == ["Head", "Lede of it."] and len(got) == 4, name
    outside = f'<body><div class="social-history"><p>Beside.</p></div><article>{body}</article></body>'
    assert len(html_text.main_text(outside).split("\n")) == 2


def test_broken_pages_take_linear_time():
    import time

    for unit, tail in (('<a "', ""), ('<a "', ">"), ("<div></b>", ""), ("<div><p>x", ""), ("<!--", ""), ("<a <", ""), ('<div class="social-history">', "")):
        start = time.perf_counter()
        html_text.main_text(unit * (1_000_000 // len(unit)) + tail)
        assert time.perf_counter() - start < 10, unit


# --- the pipeline against brute force ------------------------------------------------------------------


def jaccard_groups(texts):
    """The least index of each text's group by five-word Jaccard similarity of 0.8, by all pairs."""
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(sets))]


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage over all that its predecessor kept, with null and repeated ids, equal rows and near copies; then over nothing."""
    import corpus_pipeline

    rng = random.Random(21)
    rows = [r[:5] for r in make_rows(13, 70)]
    long = [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(90)) for _ in range(3)]
    for i in range(24):
        w = long[i % 3].split()
        w[rng.randrange(90)] = f"y{i}"
        rows.append(([None, 300, 301 + i][i % 3 if i % 2 else 2], " ".join(w), "en", "s1", 0))
    rows += [(5, "an equal row of text", "en", "s2", 0)] * 2
    folder = str(tmp_path / "sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(str(tmp_path / f"brute{i}"))
        tables.append(spark.read.parquet(str(tmp_path / f"brute{i}")))
    docs, spoken, unlike, cut, mixed, packed = tables
    both = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    # language: nothing is added, and what has no letter goes
    assert not both(spoken) - both(docs) and not [t for _, t in both(spoken) if not any(c.isalpha() for c in t or "")]
    # near duplicates: the first row of each group
    order = in_key_order(spoken)
    groups = jaccard_groups([r.c1 for r in order])
    assert len(set(groups)) < len(groups)
    assert both(unlike) == collections.Counter((order[g].c0, order[g].c1) for g in set(groups))
    # repeated passages: bytes that a string of 100 bytes covers which starts earlier too
    want = collections.Counter()
    order = in_key_order(unlike)
    gone = removed_bytes([(k, r.c1) for k, r in enumerate(order)], 100)
    for k, r in enumerate(order):
        lost, at, out = gone[k][1], 0, []
        for c in r.c1 or "":
            n = len(c.encode())
            if not lost[at : at + n].any():
                out.append(c)
            at += n
        if out or not r.c1:
            want[r.c0, "".join(out) if r.c1 is not None else None] += 1
    assert both(cut) == want and sum(x.any() for _, x in gone.values()) > 3
    # mixture: copies of rows, no document more than twice, no source beyond twice its size
    sizes = lambda df: collections.Counter({s: sum(len(words_of(r.text)) for r in rs) for s, rs in {s: [r for r in df.collect() if r.source == s] for s in {r.source for r in df.collect()}}.items()})
    whole, taken = sizes(cut), sizes(mixed)
    assert all(taken[s] <= 2 * whole[s] for s in taken) and abs(sum(taken.values()) - min(1.5 * sum(whole.values()), 2 * sum(whole.values()))) <= sum(whole.values()) * 0.1 + 400
    texts = [r.text or "" for r in cut.collect()]
    assert all(any(t.startswith((r.text or "").rstrip()) for t in texts) for r in mixed.collect())
    # sequences: every row's tokens, gapless, in sequences of 2048 at most
    tokenizer = packing.public_tokenizer()
    total = sum(len(packing_tokens(tokenizer, r.text)) + 1 for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == total
    for r in packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("p")).collect():
        at = 0
        for p in r.p:
            assert p.offset == at
            at += p.length
        assert at <= 2048
    # nothing at all
    nothing = spark.createDataFrame([], schema)
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def packing_tokens(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
