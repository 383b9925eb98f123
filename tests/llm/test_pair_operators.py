import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import passages, simhash, toxicity

from .helpers import frame, odd_rows, sentence


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(ids, prints, most=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        known = [x for x in (ids[i], least.get(root(i))) if x is not None]
        least[root(i)] = min(known, default=None)
    return [least[root(i)] for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rng = random.Random(12)
    rows = odd_rows()
    for i in range(25):
        text = sentence(rng, 120)
        rows.append((100 + 10 * i, text))
        for k in range(1, rng.randint(1, 5)):
            words = text.split()
            words[rng.randrange(len(words))] = "swap"
            rows.append((100 + 10 * i + k, " ".join(words)))
    prints = [fingerprint(r[1]) for r in rows]
    wanted = components([r[0] for r in rows], prints)
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, wanted, strict=True))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_connect_what_few_bits_connect(spark):
    rng = random.Random(13)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints |= {0, 1, (1 << 64) - 1}
    order = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in order], "fp bigint")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in edges)
    place = {p: i for i, p in enumerate(order)}
    parent = list(range(len(order)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(place[a]), root(place[b])
        parent[max(a, b)] = min(a, b)
    assert [order[root(i)] for i in range(len(order))] == components(order, order)


def test_a_list_of_many_near_copies_gives_a_forest():
    base = 0x0123456789ABCDEF
    members = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(32) for j in range(32)}), np.uint64)
    edges = simhash.forest(members)
    assert len(edges) == len(members) - 1


def near_passages(texts, least=46, share=41):
    """Per document the places of its shingles in runs of which enough are in one earlier document."""
    shingles = {d: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for d, w in texts.items()}
    out = {}
    for d in texts:
        for o in texts:
            if o < d:
                has = set(shingles[o])
                hits = [s in has for s in shingles[d]]
                for i in range(len(hits) - least + 1):
                    if sum(hits[i : i + least]) >= share:
                        out.setdefault(d, set()).update(j for j in range(i, i + least) if hits[j])
    return out


def passage_rows():
    rng = random.Random(14)
    fresh = iter(range(10**6))
    new = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    shared = [new(60), new(55), new(120), new(52)]
    edited = shared[2].split()
    edited[40] = "changed"
    rows = [
        (1, f"{new(30)} {shared[0]} {new(30)}"), (2, f"{new(10)} {shared[0]} {new(5)} {shared[1]}"), (3, f"{shared[1]} {new(20)} {shared[2]}"), (4, f"{new(7)} {' '.join(edited)}. {new(9)}"),
        (5, new(200)), (6, f"{new(3)} {new(49)}"), (7, shared[3].upper()), (8, f"É {shared[3]}, ß {new(4)} {shared[3]}"),
    ]
    rows += [(100 + i, f"{new(rng.randint(1, 40))} {shared[0]} {new(rng.randint(1, 40))}") for i in range(60)]
    return rows


def test_passages_against_brute_force(spark):
    rows = passage_rows()
    texts = dict(rows)
    words = {d: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for d, t in rows}
    spans = {d: [m.span() for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", t)] for d, t in rows}
    found = passages.near_duplicate_passages(frame(spark, rows).repartition(3)).collect()
    assert all(r.other_doc_id < r.doc_id for r in found)
    wanted = near_passages(words)
    assert {r.doc_id for r in found} == set(wanted)
    for d, places in wanted.items():
        own = [(r.start, r.end) for r in found if r.doc_id == d]
        inside = {i for i in range(len(words[d]) - 4) if any(a <= spans[d][i][0] and spans[d][i + 4][1] <= b for a, b in own)}
        assert places <= inside
    cut = {r.doc_id: r for r in passages.without_passages(frame(spark, rows)).collect()}
    assert len(cut) == len(rows) and cut[1].text == texts[1] and cut[5].text == texts[5] and cut[3].text == f"{texts[3].split(' ')[0]}"[:0] + cut[3].text
    assert all(cut[d].n_chars == len(cut[d].text) for d in cut)
    first = texts[1].split()[30:90]
    for i in range(100, 160):
        assert first[0] not in cut[i].text and first[-1] not in cut[i].text
    assert sum(" ".join(first) in r.text for r in cut.values()) == 1


def test_copies_after_variants_that_are_not_alike_enough(spark):
    rng = random.Random(21)
    fresh = iter(range(10**6))
    new = lambda n: [f"v{next(fresh)}" for _ in range(n)]
    rows, copies = [], {}
    for i in range(12):
        text = new(50)
        for j in range(6):  # four words changed: 26 to 30 of the 46 shingles stay
            variant = text[:]
            for at in (6, 18, 30, 42):
                variant[at + rng.randint(-3, 3)] = new(1)[0]
            rows.append((100 * i + j, " ".join([*new(20), *variant, *new(20)])))
        for j in (50, 51):
            rows.append((100 * i + j, " ".join([*new(20), *text, *new(20)])))
        copies[100 * i + 51] = 100 * i + 50
    found = passages.near_duplicate_passages(frame(spark, rows).repartition(3)).collect()
    assert {r.doc_id: r.other_doc_id for r in found} == copies
    assert all(r.n_words == 50 and r.similarity == 1 for r in found)


def test_near_copies_after_variants_that_are_not_alike_enough(spark):
    rng = random.Random(22)
    fresh = iter(range(10**6))
    new = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    rows = []
    for i in range(40):
        text = new(120)
        for j in range(5):  # a word in eleven changed: under half of the shingles stay
            rows.append((100 * i + j, " ".join([*new(20), *(w if rng.random() > 0.09 else new(1)[0] for w in text), *new(20)])))
        rows.append((100 * i + 50, " ".join([*new(20), *text, *new(20)])))
        near = text[:]
        near[rng.randrange(20, 100)] = new(1)[0]
        rows.append((100 * i + 51, " ".join([*new(20), *near, *new(20)])))
    words = {d: t.split() for d, t in rows}
    wanted = near_passages({d: w for d, w in words.items() if d % 100 >= 50})
    found = {}
    for r in passages.near_duplicate_passages(frame(spark, rows).repartition(4)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end))
    missed = 0
    for d, places in wanted.items():
        at, spans = 0, []
        for w in words[d]:
            spans.append((at, at + len(w)))
            at += len(w) + 1
        missed += sum(not any(a <= spans[i][0] and spans[i + 4][1] <= b for a, b in found.get(d, [])) for i in places)
    assert len(wanted) == 40 and missed <= 0.01 * sum(map(len, wanted.values()))


def test_short_near_copies_after_many_variants(spark):
    """Passages of 55 words with a word changed, after twenty variants with four words changed each."""
    rng = random.Random(5)
    fresh = iter(range(10**7))
    new = lambda n: [f"s{next(fresh)}" for _ in range(n)]
    rows = []
    for i in range(60):
        text = new(55)
        for j in range(20):
            variant = text[:]
            for at in (6, 18, 30, 42):
                variant[at + rng.randint(-3, 3)] = new(1)[0]
            rows.append((1000 * i + j, " ".join([*new(15), *variant, *new(15)])))
        near = text[:]
        near[rng.randrange(55)] = new(1)[0]
        rows += [(1000 * i + 500, " ".join([*new(15), *text, *new(15)])), (1000 * i + 501, " ".join([*new(15), *near, *new(15)]))]
    words = {d: t.split() for d, t in rows}
    wanted = set().union(*(near_passages({d: words[d] for d in (1000 * i + 500, 1000 * i + 501)}) for i in range(60)))
    found = {r.doc_id for r in passages.near_duplicate_passages(frame(spark, rows).repartition(4)).collect()}
    assert len(wanted) == 60 and len(wanted & found) >= 59


@pytest.mark.parametrize("junk", [0, 60, 70, 5000])
def test_junk_links_between_two_good_ones_lose_nothing(junk):
    good = [(100, 1100, 0), (120, 1120, 1)]
    bad = [(101 + i % 19, 3000 + 40 * i, 2) for i in range(junk)]
    rows = sorted(good + bad)
    n = len(rows)
    link = {"doc": np.full(n, 9, np.int64), "o_doc": np.full(n, 2, np.int64), "variant": np.zeros(n, np.int32), "o_variant": np.zeros(n, np.int32), "before": np.full(n, 30, np.uint8), "after": np.full(n, 30, np.uint8)}
    link |= {"c": np.array([r[0] for r in rows], np.int32), "o_c": np.array([r[1] for r in rows], np.int32), "k": np.array([r[2] for r in rows], np.uint8)}
    assert passages.regions(link) == [(9, 0, 2, 0, 70, 150, 1070, 1150)]


def test_a_word_said_over_and_over(spark):
    """Two texts of one word, and two of one line, at unlike lengths: all of the later one is a passage, and its windows are few."""
    line = "one two three four five six seven"
    rows = [(1, "w " * 3000), (2, "start " + "w " * 5000 + "end"), (3, f"{line}\n" * 400), (4, f"{line}\n" * 700), (5, "w " * 40)]
    found = passages.near_duplicate_passages(frame(spark, rows).repartition(2)).collect()
    for doc_id, words, chars in ((2, 5000, 10_000), (4, 4900, 700 * (len(line) + 1) - 1)):
        own = [(r.start, r.end) for r in found if r.doc_id == doc_id]
        inside = np.zeros(20 + 700 * 40, bool)
        for a, b in own:
            inside[a:b] = True
        assert inside.sum() >= 0.98 * chars
    assert {(r.doc_id, r.other_doc_id) for r in found} == {(2, 1), (4, 3)}


def test_windows_meet_in_turns(monkeypatch):
    rng = np.random.default_rng(7)
    n = 4000
    kinds = {"key": "u8", "prior": "u4", "next": "u4", "near_prior": "u4", "near_next": "u4"}
    w = {c: rng.integers(0, 600 if c == "key" else 3, n).astype(t) for c, t in kinds.items()}
    w["key"] = w["key"] * np.uint64(0x9E3779B97F4A7C15)
    w |= {"doc": rng.integers(0, 50, n), "variant": np.zeros(n, "i4"), "c": rng.integers(0, 900, n).astype("i4"), "before": np.full(n, 9, "u1"), "after": np.full(n, 9, "u1"), "k": rng.integers(0, 6, n).astype("u1")}
    batch = passages._dealt(w, 0, passages._WINDOW, np.zeros(n, np.int32))

    def links():
        blobs = [x for b in passages._meet([batch], 1) for x in zip(b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True)]
        found = passages._read(blobs, passages._LINK)
        return sorted(zip(*(found[c].tolist() for c in passages._LINK), strict=True))

    whole = links()
    monkeypatch.setattr(passages, "MEETING", 300)
    assert links() == whole and len(whole) > 1000


def test_texts_of_one_doc_id_are_cut_at_their_own_passages(spark):
    rng = random.Random(23)
    fresh = iter(range(10**6))
    new = lambda n: " ".join(f"t{next(fresh)}" for _ in range(n))
    shared, other = new(70), new(200)
    rows = [(1, shared), (2, f"{new(9)} {shared} {new(9)}"), (2, other), (3, other), (2, f"{new(5)} {shared}"), (4, None), (2, other)]
    rng.shuffle(rows)
    cut = passages.without_passages(frame(spark, rows)).collect()
    assert sorted(r.text for r in cut if r.doc_id == 2)[-2:] == [other, other] or sum(r.text == other for r in cut) == 2
    assert sum((r.text or "").count(shared) for r in cut) == 1 and sum((r.text or "").count(other) for r in cut) == 2
    assert all(r.n_chars == len(r.text or "") for r in cut) and len(cut) == len(rows)


def test_one_passage_in_every_document(spark):
    """A third of the corpus is one text, and all documents have one passage: every later place is found, with links in number like the places."""
    fresh = iter(range(10**6))
    new = lambda n: " ".join(f"h{next(fresh)}" for _ in range(n))
    passage, copy = new(60), new(80)
    rows = [(i, f"{new(30)} {passage} {new(30)}") for i in range(200)] + [(1000 + i, copy) for i in range(100)]
    found = passages.near_duplicate_passages(frame(spark, rows).repartition(5)).collect()
    assert {r.doc_id for r in found} == {*range(1, 200), *range(1001, 1100)}
    assert all(r.other_doc_id == 1000 and r.n_words == 80 for r in found if r.doc_id >= 1000)
    assert len([r for r in found if r.doc_id < 1000]) <= 3 * 199


def test_passages_of_odd_documents(spark):
    rows = odd_rows()
    found = passages.near_duplicate_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_doc_id) for r in found} == {(6, 5)}
    cut = passages.without_passages(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns and cut.count() == len(rows)
    assert cut.where("doc_id = 0").first().text is None and cut.where("doc_id is null").first().text == rows[-1][1]
    assert passages.near_duplicate_passages(frame(spark, [])).count() == 0


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = np.sort(rng.integers(0, 4, 80))
        values = rng.integers(0, 30, 80).astype(np.uint64)
        firsts = np.searchsorted(rows, np.arange(5))
        got = set(zip(*(x.tolist() for x in passages.compact_windows(values, rows, firsts, 9)), strict=True))
        wanted = set()
        for c in range(80):
            lo, hi = firsts[rows[c]], firsts[rows[c] + 1] - 1
            left, right = c, c
            while left > lo and values[left - 1] > values[c]:
                left -= 1
            while right < hi and values[right + 1] >= values[c]:
                right += 1
            if right - left + 1 >= 9:
                wanted.add((c, int(left), int(right)))
        assert got == wanted


INSULTS = ["blarg", "zonk", "snerfle", "gribbit"]


def toxic_rows(n=500, seed=15):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(30, 120)).split()
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    more = [(1000 + r[0] if r[0] is not None else None, *r[1:]) for r in odd_rows()]
    known = spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(frame(spark, rows + more), known).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out for i, _ in held) and not found[None].held_out
    right = [found[i].predicted == t for i, t in held]
    assert np.mean(right) > 0.95
    assert all(not found[r[0]].predicted for r in more)
    assert found[1000].score == found[1001].score


def test_scores_depend_on_the_text_alone(spark):
    rows, labels = toxic_rows(300)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    copies = [(5000 + i, t, "zz", None) for i, t in rows[:60]]
    found = {r.doc_id: r.score for r in toxicity.score_documents(frame(spark, rows + copies), known).collect()}
    assert all(found[i] == pytest.approx(found[5000 + i]) for i, _ in rows[:60])


def test_copies_of_one_text_are_voted_on_by_others(spark):
    rows, labels = toxic_rows()
    copies = [(5000 + i, rows[next(i for i, _, t in labels if t)][1]) for i in range(600)]
    plain = [(8000 + i, f"qq{i}") for i in range(40)]  # without a term of the vocabulary
    known = spark.createDataFrame(labels + [(i, 1, 1) for i, _ in copies] + [(i, 1, 0) for i, _ in plain], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(frame(spark, rows + copies + plain + [(9000, "")]), known).collect()}
    assert found[5000].score > max(0.5, found[9000].score) and not found[9000].predicted
    assert len({r.doc_id for r in found.values() if r.doc_id and 5000 <= r.doc_id < 8000 and r.predicted}) == 600
    assert all(len({e.doc_id for e in r.evidence} & {i for i, _ in copies}) <= 1 for r in found.values())


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = toxic_rows(20)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.score_documents(frame(spark, rows), none).collect()} == {0.5}
    assert toxicity.score_documents(frame(spark, []), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(150):
        terms = np.unique(rng.integers(0, 60, rng.integers(0, 12)))
        weights = rng.random(len(terms)) + 0.1
        vectors.append((terms, weights / np.linalg.norm(weights) if len(terms) else weights))
    dense = np.zeros((150, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, block=8)
    queries = [vectors[i] for i in range(0, 150, 3)]
    rows = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
    got, who = index.nearest(rows, np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries]), len(queries), 10)
    for q, (t, w) in enumerate(queries):
        every = dense[:, t] @ w if len(t) else np.zeros(150)
        assert np.allclose(got[q], np.sort(every)[::-1][:10])
        assert np.allclose(every[who[q]], got[q])


def test_votes_against_brute_force(spark):
    rng = random.Random(31)
    idf = np.array([1 + rng.random() for _ in range(40)])
    text = lambda: sorted(rng.sample(range(40), rng.randint(0, 9)))
    rows = [(i, 1000 + i % 130, t := text(), [rng.randint(1, 4) for _ in t]) for i in range(150)]
    examples = [(i, key, rng.random(), terms, counts) for i, key, terms, counts in rows[:110] if terms]
    table = spark.createDataFrame([(i, key, t, c) for i, key, t, c in rows], "doc_id bigint, text_key bigint, terms array<int>, counts array<int>")
    index = toxicity.build_index([(t, c) for *_, t, c in examples], idf)
    found = {r.doc_id: r for r in toxicity.votes(table, index, idf, [e[:3] for e in examples], nearest=7).collect()}

    def vector(terms, counts):
        v = np.zeros(40)
        v[terms] = (1 + np.log(counts)) * idf[terms] if terms else []
        return v / (np.linalg.norm(v) or 1)

    k = min(max(len(examples) // 20, 5), 7)
    for i, key, terms, counts in rows:
        near = sorted(((float(vector(terms, counts) @ vector(t, c)), share, j) for j, own, share, t, c in examples if own != key), reverse=True)[:k]
        weight = sum(c for c, *_ in near)
        assert (found[i].vote is None) == (weight == 0)
        if weight:
            assert found[i].vote == pytest.approx(sum(c * s for c, s, _ in near) / weight)


def test_the_curve_is_the_most_likely_one():
    rng = np.random.default_rng(8)
    values = (np.arange(40) + 0.5) / 40
    toxic, clean = rng.integers(0, 30, 40) * values, rng.integers(1, 60, 40) * (1 - values)
    a, b = toxicity.fit_curve(values, toxic, clean)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a + b * values)))
        return -(toxic * np.log(p) + clean * np.log(1 - p)).sum() + 0.0005 * b * b

    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.2, 0, 0.2))
