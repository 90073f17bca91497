"""Operators against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from termweave.llm import decontam, line_dedup, minhash, packed_ids, packing, pii, quality_gbdt, quality_rules, token_counts, toxicity
from termweave.llm.codec import Codec, kind_of, load_tokenizer
from termweave.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path
from termweave.llm.text_stats import stats

from .conftest import prose


@pytest.fixture(scope="module")
def exact(odd_rows):
    byte, word = load_tokenizer(tokenizer_path(BYTE_BPE)), load_tokenizer(tokenizer_path(WORD_BPE))
    enc = lambda tok: [(d, tok.encode(t or "", add_special_tokens=False).ids) for d, t in odd_rows]
    return enc(byte), enc(word)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_codec_on_random_text(name):
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(0x250), *range(0x2010, 0x203B))] + list("  '''ssstttreve \n\n\t") * 12 + ["<|endoftext|>", "日本", "́"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    c = Codec(tokenizer_path(name), kind_of(tokenizer_path(name)), limit=3000)
    assert c.kind in ("byte", "word")
    want = c.whole(texts)
    for at in range(0, len(texts), 500):
        assert [a.tolist() for a in c.ids(texts[at : at + 500])] == want[at : at + 500]


def test_token_counts(odd, odd_rows, exact):
    got = token_counts.count_tokens(odd, tokenizer_path(BYTE_BPE), limit=100).collect()
    want = Counter((d, len((t or "").encode()), len(ids), len(ids) > 100) for (d, t), (_, ids) in zip(odd_rows, exact[0], strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_packed_ids_round_trip(odd, exact):
    got = packed_ids.read_shards(packed_ids.write_shards(odd, tokenizer_path(BYTE_BPE))).toPandas().sort_values("start")
    want = Counter((d, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for d, ids in exact[0])
    assert Counter((None if d != d else int(d), int(n), int(c)) for d, n, c in got[["doc_id", "n_tokens", "ids_crc32"]].itertuples(index=False)) == want
    assert got["start"].tolist() == [0, *np.cumsum(got["n_tokens"])[:-1].tolist()]
    assert got["doc_id"].dropna().is_monotonic_increasing


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 24])
def test_bit_packing(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, rng.integers(0, 700)).astype("<u4") for _ in range(40)]
    with open(tmp_path / "s", "wb") as f:
        w = packed_ids.ShardWriter(f, bits, block=256)
        for k in range(0, 40, 7):
            w.add(list(range(k, min(k + 7, 40))), docs[k : k + 7])
        w.close()
    import pyarrow.fs as pafs

    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "s")) as f:
        r = packed_ids.ShardReader(f)
        assert all((r.doc(k) == docs[k]).all() and len(r.doc(k)) == len(docs[k]) for k in range(40))
        whole = np.concatenate(docs)
        assert (r.ids(100, 1000) == whole[100:1000]).all()
    assert packed_ids.bits_for(50257) == 16 and packed_ids.bits_for(32000) == 15


def test_line_dedup(odd, odd_rows, monkeypatch):
    key = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in odd_rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40 and d is not None:
                holders[key(s)].add(d)
    often = {k: max(ds) for k, ds in holders.items() if len(ds) >= 5}
    want = Counter()
    for d, t in odd_rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if key(s) not in often or often[key(s)] == d]
        want[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    for limit in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        got = line_dedup.dedup_lines(odd, batches=4).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    got = line_dedup.dedup_lines(odd).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    assert sum(r.n_dropped for r in got) == 22


def test_line_runs_level_by_level(spark, monkeypatch):
    """Each batch meets the runs before it; runs of a level are compacted; counts stay whole, also of very common keys."""
    rng = random.Random(18)
    rows = [(d, f"line {rng.randrange(40)}".encode()) for d in range(300) for _ in range(4)] + [(d, b"everywhere") for d in range(300)]
    met, add = [], line_dedup.LineRuns.add
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, lines: (met.append(len(self.runs())), add(self, lines))[1])
    runs = line_dedup.LineRuns(spark, min_docs=7, fanout=3)
    for lo in range(250, -1, -50):
        batch = [r for r in rows if lo <= r[0] < lo + 50]
        runs.add(spark.createDataFrame(batch, "doc_id long, line binary"))
        tables = [runs.table(r).toPandas() for r in runs.runs()]
        # a key stands with a doc_id in one run only
        assert max(Counter(bytes(x) for t in tables for x in t[t["max_doc"].notna()]["line"]).values()) == 1
    assert met == [0, 1, 2, 1, 2, 3]
    holders = defaultdict(set)
    for d, x in rows:
        holders[x].add(d)
    got = {bytes(r.line): (r.n_docs, r.max_doc) for r in runs.finish().collect()}
    assert got == {x: (len(ds), max(ds)) for x, ds in holders.items() if len(ds) >= 7} and got[b"everywhere"] == (300, 299)
    assert not spark.sql("SHOW TABLES").where("tableName LIKE 'line_run%'").count()


def test_near_duplicates(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([3, 6, 20, 80, 200])) for _ in range(60)]
    for t in list(texts):
        for _ in range(rng.choice([0, 1, 4])):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 100))
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(sets[d]), find(d), find(d) == d) for d in sets}


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 150).split()
    rows = []
    for d in range(600):
        w = list(base)
        w[rng.randrange(len(w))] = f"odd{d}"
        rows.append((d, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def copies_of(rng, n, edits):
    """A text of 200 words and copies with some words replaced, the text itself somewhere among them."""
    base = prose(rng, 200).split()
    texts = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), edits):
            w[at] = f"new{k}x{at}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_copies_that_only_meet_in_their_original(spark):
    rows = copies_of(random.Random(11), 500, 5)
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, w in ((d, t.lower().split()) for d, t in rows)}
    part = {d: d for d in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if part[a] != part[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {d: new if c == old else c for d, c in part.items()}
    assert max(Counter(part.values()).values()) > 300
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == part


def components_of(rows):
    """The component of each id by comparing all pairs of sets."""
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids, part = sorted(sets), {d: d for d in sets}
    names = {g: k for k, g in enumerate({g for s in sets.values() for g in s})}
    owner = [[names[g] for g in sets[d]] for d in ids]
    has = np.zeros((len(ids), len(names)), np.float32)
    for k, o in enumerate(owner):
        has[k, o] = 1
    both, n = has @ has.T, has.sum(1)
    near = (100 * both >= 75 * (n[:, None] + n[None, :] - both)) & (both > 0)
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        old, new = max(part[ids[i]], part[ids[j]]), min(part[ids[i]], part[ids[j]])
        if old != new:
            part = {d: new if c == old else c for d, c in part.items()}
    return part


def template_corpus(rng, n):
    """Texts of one 400-word template with seven words of their own each, and a near copy of each by ten more changes."""
    base, rows = prose(rng, 400).split(), []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), 7):
            w[at] = f"own{k}x{at}"
        rows.append(" ".join(w))
        for at in rng.sample(range(len(w)), 10):
            w[at] = f"copy{k}x{at}"
        rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_one_template_many_texts(spark):
    """Buckets of many texts that mostly aren't linked: every component is found all the same."""
    rows = template_corpus(random.Random(14), 300)
    want = components_of(rows)
    assert 2 < len(set(want.values())) < 400
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_blocks_of_a_crowded_bucket(spark, monkeypatch):
    """Blocks of a few members each give the same components."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "CROWD", 9)
    monkeypatch.setattr(minhash, "WEIGHT", 5000)
    rng = random.Random(15)
    rows = template_corpus(rng, 40) + [(1000 + d, t) for d, t in copies_of(rng, 120, 5)] + [(2000 + d, t) for d, t in copies_of(rng, 60, 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(rows)


def test_chains_and_small_sets(spark):
    rng, rows = random.Random(16), []
    for c in range(4):
        w = prose(rng, 120).split()
        for k in range(40):  # each link of a chain changes one word more
            rows.append((c * 100 + k, " ".join(w)))
            w[(k * 31) % 120] = f"step{c}x{k}"
    for c in range(60):
        w = prose(rng, rng.randint(5, 24)).split()
        rows.append((1000 + 3 * c, " ".join(w)))
        rows.append((1001 + 3 * c, " ".join(w[:-1])))
        rows.append((1002 + 3 * c, " ".join([*w, "more"])))
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(rows)


def test_linked_sets_of_a_block():
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(120, 200)], rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(12)]
        names, sides = rng.integers(0, 9, 12).tolist(), rng.integers(0, 2, 12).tolist()
        for side in (sides, [0] * 12):
            part = {n: n for n in names}
            for i in range(12):
                for j in range(12):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if (len(set(side)) == 1 or side[i] != side[j]) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        old, new = max(part[names[i]], part[names[j]]), min(part[names[i]], part[names[j]])
                        part = {n: new if c == old else c for n, c in part.items()}
            got = {n: n for n in names}
            for i, j in minhash.linked(sets, names, side, chunk=64):
                old, new = max(got[names[i]], got[names[j]]), min(got[names[i]], got[names[j]])
                assert old != new  # a forest
                got = {n: new if c == old else c for n, c in got.items()}
            assert got == part


def test_one_doc_id_with_different_texts(spark):
    """A link of any of its texts is a link of the doc_id."""
    rng = random.Random(17)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (5, a + " end"), (5, b), (5, b), (7, b + " end"), (9, c), (3, c), (9, a)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 3: 1}


def test_substitutions_are_tolerated(spark):
    rng = random.Random(4)
    item = prose(rng, 40).split()
    changed = [w if k % 13 != 6 else "swapped" for k, w in enumerate(item)]
    docs = [(1, f"{prose(rng, 50)} {' '.join(changed)} {prose(rng, 50)}"), (2, prose(rng, 200)), (3, " ".join(item[:20]).upper()), (4, " ".join(item[:7]) + " " + prose(rng, 60))]
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 9), (3, 9)}
    one = next(r for r in got if r.doc_id == 3)
    assert (one.start, one.end) == (0, 20)


def plain_leaks(docs, items):
    """All windows and masks of all documents against all items, and the best stretch around each hit."""
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    pick = lambda w, at, m: tuple(w[at + k] for k, x in enumerate(m) if x == "1")
    out, span = {}, decontam.SPAN
    for d, t in docs:
        w = tokens(t)
        for i, b in ((i, tokens(x)) for i, x in items):
            shifts = set()
            for m in decontam.MASKS:
                first = {}
                for j in range(len(b) - span, -1, -1):
                    first[pick(b, j, m)] = j
                shifts |= {at - first[pick(w, at, m)] for at in range(len(w) - span + 1) if pick(w, at, m) in first}
            if decontam.SHORTEST <= len(b) < span:
                shifts |= {at for at in range(len(w) - len(b) + 1) if w[at : at + len(b)] == b}
            need, best = (len(b) if len(b) < span else min(decontam.NEED, int(np.ceil(len(b) * 0.7)))), 0
            for s in shifts:
                run = 0
                for k in range(max(0, -s), min(len(b), len(w) - s)):
                    run = max(run + (1 if w[s + k] == b[k] else -2), 0)
                    best = max(best, run)
            if shifts and best >= need:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_leaks_against_all_windows(spark, monkeypatch):
    rng = random.Random(19)
    items = [(k, prose(rng, n)) for k, n in enumerate((2, 3, 4, 7, 10, 11, 12, 15, 17, 18, 25, 60))]
    docs = []
    for d in range(160):
        words = items[d % len(items)][1].split()
        lo = rng.randrange(len(words)) if d % 3 == 0 else 0
        part = words[lo : lo + rng.randint(6, 40)] if d % 3 else words
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            part[rng.randrange(len(part))] = rng.choice(["other", *words])
        docs.append((d, " ".join([prose(rng, rng.randint(0, 30)), *part, *(part if d % 7 == 0 else []), prose(rng, 10)])))
    want = plain_leaks(docs, items)
    assert {i for _, i in want} >= set(range(1, 12)) and len(want) > 60
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(a, b).collect()} == want
    for limit in ("BROADCAST_ROWS", "BROADCAST_TOKENS", "BROADCAST_PAIRS"):
        monkeypatch.setattr(decontam, limit, 0)
    assert {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(a, b).collect()} == want


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rng = random.Random(6)
    alphabet = list("0123456789") * 3 + list("..@@++--  ()aZ_%,é𝒳") + ["4111111111111111", "a@b.c", "10.0.0.1", "+1 (555) 555-0100", "x.y@z.w.v@u.t"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(4000)]
    got = pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    text = F.array_join(F.concat(*[pii._joined(k, F.col(k)) for k in pii.KINDS]), ",")
    found = {r.doc_id: r.s for r in got.select("doc_id", text.alias("s")).collect()}
    assert found == {k: base_spans(t) for k, t in rows}


def flagged_terms(rows, remove, generalise, strength=8):
    """Every term over the threshold, by counting all terms beside all entities."""
    words, entities = [], []
    for _, t in rows:
        words.append(set(re.findall(r"[^\W\d_]{4,}", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", " ", t).lower())))
        own = set()
        for span in filter(None, base_spans(t).split(",")):
            kind, lo, hi = span.split(":")
            v = t[int(lo) : int(hi)].lower()
            own |= {("any", "kind", ""), (kind, "kind", ""), (kind, "value", v)}
            own |= {("email", "domain", v.split("@")[1]), ("email", "local", v.split("@")[0])} if kind == "email" else set()
            own |= {("ip", "network", ".".join(v.split(".")[:3]))} if kind == "ip" else set()
        entities.append(own)
    n, n_t, n_e = len(rows), Counter(w for ws in words for w in ws), Counter(e for es in entities for e in es)
    both = Counter((w, e) for ws, es in zip(words, entities, strict=True) for w in ws for e in es)
    out = {}
    for (w, e), k in both.items():
        left = -np.log2((k + strength * n_e[e] / n) / (n_t[w] + strength))
        ic = np.log2(n / n_e[e])
        if left <= generalise and ic > 0 and ic - left >= ic / 2:
            out.setdefault(w, []).append((left, round(ic - left, 9), e[0]))
    return {w: ("removed" if min(x)[0] <= remove else "generalised", max(y[1:] for y in x)[1]) for w, x in out.items()}


def planted_terms(rng):
    """Names that stand with entities: always, mostly, or hardly more often than by chance."""
    rows = [(k, prose(rng, 40)) for k in range(300)]
    rows += [(1000 + k, f"{prose(rng, 20)} agent Fitzroyal {prose(rng, 5)} jo.f{k}@corp.example soon {prose(rng, 20)}") for k in range(40)]
    rows += [(2000 + k, f"{prose(rng, 20)} router Östermalm {prose(rng, 5)} 10.1.2.{k} {prose(rng, 20)}") for k in range(12)]
    rows += [(3000 + k, f"{prose(rng, 20)} router and ÖSTERMALM off") for k in range(2)]
    rows += [(4000 + k, f"{prose(rng, 20)} agent unrelated {prose(rng, 3)}") for k in range(60)]
    rows += [(5000 + k, f"unrelated {prose(rng, 5)} +1 (555) 555-01{k:02}") for k in range(6)]
    return rows + [(6000, f"{prose(rng, 20)} and Fitzroyal left; fitzroyal@x.yz has Fitzroyals")]


def test_terms_that_reveal_are_found(spark):
    rows = planted_terms(random.Random(7))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = flagged_terms(rows, pii.REMOVE, pii.GENERALISE)
    assert want["fitzroyal"] == ("removed", "email") and want["östermalm"][1] == "ip" and "unrelated" not in want and len(want) < 30
    found = pii.find_personal_data(df)
    by = {r.doc_id: r for r in found.collect()}
    for d, t in rows:
        base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(t).split(",") if x.startswith("email")]
        spans = {"removed": [], "generalised": []}
        for m in re.finditer(r"[^\W\d_]+", t):
            if m[0].lower() in want and not any(m.start() < q and m.end() > p for p, q in base):
                kind, to = want[m[0].lower()]
                spans[kind].append((m.start(), m.end(), to))
        assert {k: [tuple(s) for s in by[d][k]] for k in spans} == spans
        every = [*filter(None, [base_spans(t)]), *(f"{k}:{p}:{q}" for k in pii.TERM_KINDS for p, q, _ in spans[k])]
        assert by[d].spans == ",".join(every) and by[d].base_spans == base_spans(t)
    clean = found.join(spark.createDataFrame(rows, "doc_id long, body string"), "doc_id")
    said = {r.doc_id: r.t for r in clean.select("doc_id", pii.sanitise(F.col("body"), *pii.KINDS, *pii.TERM_KINDS).alias("t")).collect()}
    assert "[EMAIL]" in said[1000] and "corp.example" not in said[1000] and "Fitzroyal " not in said[6000]
    assert said[3] == rows[3][1]


def test_terms_beyond_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(planted_terms(random.Random(8)), "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()} == want


def test_quality_counts(odd, odd_rows):
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for s in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", s):
                dup += s in seen
                seen.add(s)
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = set()
        for k in range(len(w) - 7):
            if n[tuple(w[k : k + 8])] > 1:
                cover.update(range(k, k + 8))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)

    more = ["a b c d e f g h a b c d e f g h i", "x " * 30, "# $ %\n# $ %\n\n\n", "a b"]
    for t in [t or "" for _, t in odd_rows] + more:
        assert tuple(stats(t)[0]) == plain(t)
    for r in quality_rules.judge_quality(odd).collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    n, rules = 20_000, len(quality_rules.RULES)
    good = rng.random(n) < 0.8
    vote = np.where(good[:, None], rng.choice([0, 1, 2], (n, rules), p=[0.05, 0.15, 0.8]), rng.choice([0, 1, 2], (n, rules), p=[0.6, 0.2, 0.2]))
    codes = (vote * 3 ** np.arange(rules - 1, -1, -1)).sum(1)
    kinds, counts = np.unique(codes, return_counts=True)
    post, theta, share = quality_rules.estimate(kinds, counts.astype(float))
    assert abs(share - 0.8) < 0.02 and abs(theta[:, 0, 0].mean() - 0.6) < 0.05
    assert ((post[np.searchsorted(kinds, codes)] >= 0.5) == good).mean() > 0.97


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality_gbdt.fit(x[:2000], y[:2000])
    assert (((m.score(x[2000:]) >= 0.5) == y[2000:]).mean()) > 0.95

    def walk(row):
        total = m.bias
        for f, t, v in zip(m.feature, m.threshold, m.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - len(f)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], m.raw(x[:50]))


def test_offending_sentences():
    weights, bias = {"awful$": 9.0}, -5.0
    s = toxicity.Scorer(weights, bias)
    text = "A fine day. You are awful! Good bye."
    score, n, hot = s.text(text)
    assert n == 3 and score > 0.9 and [text[a:b] for a, b, _ in hot] == [" You are awful!".strip()]
    p = [1 / (1 + np.exp(5)), 1 / (1 + np.exp(-4)), 1 / (1 + np.exp(5))]
    assert abs(score - (1 - np.prod([1 - q for q in p]))) < 1e-9


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for k in range(400):
        bad = k % 5 == 0
        words = prose(rng, 60).split()
        if bad:
            words.insert(rng.randrange(60), "vilelout")
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), most=300).toPandas()
    truth = dict(marks)
    held = got[got["held_out"]]
    assert len(held) > 40 and (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.95


def test_packing_bounds_and_offsets():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = np.sort(rng.integers(1, 101, rng.integers(1, 200)))[::-1]
        bins, offsets, free = packing.best_fit(n, 100)
        used = np.bincount(bins, n)
        assert (used <= 100).all() and (100 - used == free).all()
        assert packing.lower_bound(n, 100) <= len(free)
        for b in range(len(free)):
            o = np.argsort(offsets[bins == b])
            assert offsets[bins == b][o].tolist() == [0, *np.cumsum(n[bins == b][o])[:-1].tolist()]
    assert packing.lower_bound(np.array([60] * 10), 100) == 10


def test_packing_exchanges(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(100, 1500, 3000))]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, 2048, per_partition=200).toPandas()
    assert len(got) == 3000
    bound = packing.lower_bound(got["length"].to_numpy(), 2048)
    assert got["sequence_id"].nunique() <= bound * 1.02 + 2
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1].tolist()] and g["length"].sum() <= 2048


def test_packed_documents(odd, exact):
    got = packing.pack_documents(odd, tokenizer_path(WORD_BPE)).collect()
    want = Counter()
    for d, ids in exact[1]:
        ids = np.array([*ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[d, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_sha_of_kept_text(odd):
    got = line_dedup.dedup_lines(odd).select("kept_text", F.sha2("kept_text", 256).alias("h")).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.h for r in got)
