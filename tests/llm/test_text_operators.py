import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, fingerprints, kneser_ney, licenses, quality_rules, words
from tessera.llm.queries import op5_chat_format
from tessera.llm.shared import text_bytes
from tessera.llm.words import word_hashes

from .helpers import frame, odd_rows, sentence


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "B", "b", " ", "\n", "é", "É", "!", "zz", "9", "x" * 9], k=rng.randint(0, 30))) for _ in range(800)] + [None, "", " "]
    hashes, rows, _, _ = word_hashes(*text_bytes(pa.array(texts)))
    found, word_of = {}, {}
    for h, row in zip(hashes.tolist(), rows.tolist(), strict=True):
        found.setdefault(row, []).append(h)
    for i, text in enumerate(texts):
        words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())]
        assert len(words) == len(found.get(i, []))
        for h, word in zip(found.get(i, []), words, strict=True):
            assert word_of.setdefault(h, word) == word
    assert len(set(word_of.values())) == len(word_of)


def test_words_are_the_same_in_pieces_of_any_size(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "Bc", " ", "\n", "é", "!", "z" * 90, "9"], k=rng.randint(0, 40))) for _ in range(300)] + ["q" * 5000, "r" * 700, "", "s" * 300 + " t"]
    data, bounds = text_bytes(pa.array(texts))
    whole = word_hashes(data, bounds)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(words, "PIECE", size)
        assert all((a == b).all() for a, b in zip(whole, word_hashes(data, bounds), strict=True))


def quartile_digest(text):
    """The digest of a text, byte by byte from the definition."""
    counts = [0] * fingerprints.BUCKETS
    for k, (i, j, last) in enumerate(fingerprints.SPACINGS):
        for at in range(len(text) - last):
            h = (text[at + i] * 0x9E3779B1 + text[at + j] * 0x85EBCA6B + text[at + last] * 0xC2B2AE35 + k * 0x27D4EB2F) % (1 << 32)
            h = (h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)
            counts[(h ^ h >> 12) % fingerprints.BUCKETS] += 1
    ranked = sorted(counts)
    codes = [sum(c > ranked[q * fingerprints.BUCKETS // 4 - 1] for q in (1, 2, 3)) for c in counts]
    return [min(255, int(8 * np.log2(1 + len(text)))), *codes]


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(0, 300))) for i in range(40)] + [(50, "é中😀" * 30), (51, None), (52, "aaaa"), (53, "x" * 3000)]
    found = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, rows).repartition(4)).collect()}
    digests = {i: quartile_digest((t or "").encode()) for i, t in rows}

    def written(d):
        return f"{d[0]:02x}" + "".join(f"{d[i] << 6 | d[i + 1] << 4 | d[i + 2] << 2 | d[i + 3]:02x}" for i in range(1, len(d), 4))

    def alike(a, b):
        return 1 - (sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) + min(fingerprints.LENGTH_MOST, fingerprints.LENGTH_WEIGHT * abs(a[0] - b[0]))) / fingerprints.MOST

    for n, (i, text) in enumerate(rows):
        after, following = rows[(n + 1) % len(rows)]
        text, following = text or "", following or ""
        edited = quartile_digest((text[: len(text) - len(text) // 4] + following[: len(text) // 4]).encode())
        r = found[i]
        assert (r.fingerprint, r.edited_fingerprint) == (written(digests[i]), written(edited))
        assert (r.near_edited, r.near_next) == pytest.approx((alike(digests[i], edited), alike(digests[i], digests[after])))


def test_fingerprints_follow_each_other(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    found = [r.asDict() for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect()]
    order = sorted(((r[0], r[1] or "") for r in rows))
    wanted = []
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        wanted.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == sorted(wanted)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[5]["near_next"] == 1.0
    assert by[0]["fingerprint"] == by[1]["fingerprint"]
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    assert fingerprints.fingerprint_documents(frame(spark, [(None, "a b c d"), (1, None)])).count() == 2


def test_likeness_is_bounded_and_tells_edits_from_others():
    rng = random.Random(4)
    near, far = [], []
    for _ in range(60):
        a, b = sentence(rng, 300), sentence(rng, rng.randint(20, 600))
        codes = [fingerprints.quartile_codes(x.encode()) for x in (a, fingerprints.edited_text(a, b), b)]
        near.append(fingerprints.likeness(codes[0], codes[1]))
        far.append(fingerprints.likeness(codes[0], codes[2]))
    assert np.mean(np.array(near) > np.array(far)) > 0.95
    assert len(fingerprints.as_text(codes[0])) == 2 + fingerprints.BUCKETS // 2


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string, at int")


def test_chat_reads_back_what_was_said(spark):
    rng = random.Random(6)
    marks = ["###", "####", "### Assistant: ", "</turn>", "</turn>\n", "<|also|>", "\\", "\\l", "\\h", "\\b", "<", "#", "é", "\n", ": ", "a"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys:tem", "a\\c"]), "".join(rng.choices(marks, k=rng.randint(0, 8)))) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(100, 0, None, None), (101, 3, "user", "late"), (101, None, "user", "first"), (102, 0, "assistant", "tie"), (102, 0, "assistant", "tie"), (None, 0, "user", "x")]
    out = chat_format.format_conversations(conversations(spark, rows))
    got = out.select("conv_id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in own]
        assert list(r.loss) == [text for _, _, role, text in own if role == "assistant"]
        assert r.formatted.count(chat_format.END) >= 1
    assert chat_format.format_conversations(conversations(spark, [])).count() == 0


def test_chat_merges_turns_of_one_role(spark):
    out = chat_format.format_conversations(conversations(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])).first()
    assert out.formatted == "### user: a<|also|>b</turn>\n### assistant: c</turn>\n"
    assert [tuple(s) for s in out.loss_spans] == [(out.formatted.index("c</turn>"), 1)]


def test_chat_query_stays_in_the_jvm(spark):
    plan = op5_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def base_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(i, i + 8))
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def quality_rows():
    rng = random.Random(8)
    rows = odd_rows()
    phrase = sentence(rng, 12)
    rows += [(20, " ".join([phrase, sentence(rng, 100), phrase])), (21, f"{phrase}\n" * 9), (22, "a b c d e f g h " * 4), (23, "#*$%&|<> " * 30), (24, "\x0b\x0c\r".join(["w"] * 30))]
    for i in range(300):
        rows.append((100 + i, f"{sentence(rng, rng.randint(25, 200)).capitalize()}.", rng.choice(["en", "de"]), rng.choice(["s1", "s2", None])))
    rows += [(900 + i, " | ".join(sentence(rng, 60).split()), "en", "s1") for i in range(6)] + [(950 + i, sentence(rng, 60).upper() + "!!!", "de", "s2") for i in range(6)]
    return rows


def test_quality_measures_against_brute_force(spark):
    rows = quality_rows()
    found = quality_rules.judged_documents(frame(spark, rows), min_docs=50).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for doc_id, text, *_ in rows:
        r = by[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(text), doc_id
        assert not (r.base_failed and r.kept)
    assert not any(by[i].kept for i in [*range(900, 906), *range(950, 956)])
    assert np.mean([by[100 + i].kept for i in range(300)]) > 0.97
    assert quality_rules.judged_documents(frame(spark, [])).count() == 0
    assert quality_rules.judged_documents(frame(spark, [(1, None)])).first().kept is False


def fence_by_hand(values, measure):
    tail, reach, up, _ = quality_rules.MEASURES[measure]
    values = sorted(values)
    at = lambda per_mille: values[(len(values) * per_mille + 999) // 1000 - 1]
    return at(tail) + max(reach * (at(tail) - at(500)), up), at(500)


def measured_rows(spark, rows):
    """rows: lang, source, value of every measure."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, source string, value int")
    return df.selectExpr("doc_id", "lang", "source", "false as base_failed", *[f"value as {m}" for m in quality_rules.MEASURES])


def test_quality_fences_are_tail_quantiles(spark):
    rows = [("en" if i % 2 else "de", "s", i % 97) for i in range(400)]
    found = {(r.level, r.lang, r.source): r for r in quality_rules.fences(measured_rows(spark, rows)).collect()}
    for lang in ("en", "de"):
        values = [v for own, _, v in rows if own == lang]
        for measure in quality_rules.MEASURES:
            most, median = fence_by_hand(values, measure)
            every, middle = fence_by_hand([v for _, _, v in rows], measure)
            assert found[(2, lang, "s")].n_docs == len(values)
            assert found[(2, lang, "s")].fence[measure].most == min(most, median + quality_rules.WIDER * (every - middle))
    assert found[(0, "", "")].n_docs == 400


def test_quality_fences_follow_each_groups_tail(spark):
    rng = random.Random(18)
    rows = [("en", "narrow", rng.randint(0, 20)) for _ in range(500)] + [("en", "wide", rng.randint(0, 120)) for _ in range(500)]
    measured = measured_rows(spark, rows)
    fence = {r.source: r.fence for r in quality_rules.fences(measured).collect() if r.level == 2}
    assert not any(fence[s][m].by_floor for s in ("narrow", "wide") for m in ("echo_rate", "capital_rate", "mean_word"))
    assert all(fence["narrow"][m].most < fence["wide"][m].most for m in quality_rules.MEASURES)
    extra = measured_rows(spark, rows + [("en", "narrow", 150), ("en", "wide", 150)])
    kept = {(r.source, r.symbol_rate): r.kept for r in quality_rules.judge(extra, min_docs=50).collect()}
    assert kept[("wide", 150)] and not kept[("narrow", 150)]


def test_a_source_of_junk_keeps_its_rules(spark):
    rng = random.Random(19)
    rows = [("en", f"s{i % 10}", rng.randint(0, 12)) for i in range(5000)] + [("en", "s0", 700) for _ in range(200)]  # two sevenths of s0
    judged = quality_rules.judge(measured_rows(spark, rows), min_docs=50).collect()
    assert not any(r.kept for r in judged if r.echo_rate == 700)
    assert sum(r.kept for r in judged) > 4900


def kneser_ney_by_hand(trusted):
    """P(byte | bytes before) by dictionaries, from the definition."""
    order = kneser_ney.ORDER
    pad = bytes(order - 1)
    tables = {order: Counter()}
    for text in trusted:
        data = pad + text
        tables[order].update(data[i : i + order] for i in range(len(text)))
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    d = {n: kneser_ney.discounts(Counter(t.values())) for n, t in tables.items()}
    contexts = {n: {} for n in tables}
    for n, t in tables.items():
        for g, c in t.items():
            contexts[n].setdefault(g[:-1], []).append(c)

    def probability(gram):
        if not gram:
            return 1 / 256
        n, lower = len(gram), probability(gram[1:])
        counts = contexts[n].get(gram[:-1])
        if not counts:
            return lower
        c, cut = tables[n].get(gram, 0), lambda k: d[n][min(k, 3) - 1]
        return ((c - cut(c)) / sum(counts) if c else 0) + sum(map(cut, counts)) / sum(counts) * lower

    return probability


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randint(1, 40))) for i in range(60)] + [(100, None), (101, ""), (102, "é中😀 ß" * 5), (103, "q" * 700), (104, sentence(rng, 30)), (None, "x y"), (104, "again")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(102, 1, 0), (103, 0, 0)], "doc_id bigint, quality int, toxic int")
    probability = kneser_ney_by_hand([t.encode() for i, t in rows if i is not None and t and (i < 40 or i == 102)])
    contexts = [b"\0\0\0\0", b"alph", b"zzzz", "é".encode() * 2, b"a et"]
    assert all(sum(probability(c + bytes([b])) for b in range(256)) == pytest.approx(1) for c in contexts)
    wanted = []
    for i, text in rows:
        data = bytes(kneser_ney.ORDER - 1) + (text or "").encode()
        logs = [np.log(probability(data[k : k + kneser_ney.ORDER])) for k in range(len(data) - kneser_ney.ORDER + 1)]
        wanted.append((str(i), len(logs), float(np.exp(-np.mean(logs))) if logs else 0.0))
    found = kneser_ney.judge_documents(frame(spark, rows).repartition(3), labels, min_docs=10).collect()
    found = sorted((str(r.doc_id), r.n_bytes, r.perplexity or 0.0) for r in found)
    assert [r[:2] for r in found] == [r[:2] for r in sorted(wanted)]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in sorted(wanted)], rel=1e-5)


def test_gram_counts_against_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 4]
    wanted = Counter()
    for _, text, *_ in rows:
        data = bytes(kneser_ney.ORDER - 1) + (text or "").encode()
        wanted.update(data[i : i + kneser_ney.ORDER] for i in range(len(data) - kneser_ney.ORDER + 1))
    counts = kneser_ney.count_grams(frame(spark, rows), 4).collect()
    found = {}
    for r in counts:
        if r.kind == 0:
            grams, n = kneser_ney.unpacked(bytes(r.data), r.n, "i8")
            found |= {int(g).to_bytes(kneser_ney.ORDER, "big"): int(k) for g, k in zip(grams, n, strict=True)}
    assert found == wanted
    for order in range(3, kneser_ney.ORDER + 1):
        types = Counter(g[-order:] for g in {g[-order - 1 :] for g in wanted}) if order < kneser_ney.ORDER else wanted
        for i in range(1, 5):
            assert sum(r.n for r in counts if r.kind == order and r.gram == i) == sum(v == i for v in types.values())


def test_grams_are_packed_reversibly():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5000):
        grams = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        counts = rng.integers(1, 1 << 40, len(grams))
        back, more = kneser_ney.unpacked(kneser_ney.packed(grams, counts), len(grams), "i8")
        assert (back == grams).all() and (more == counts).all()


def test_discounts():
    d1, d2, d3 = kneser_ney.discounts({1: 100, 2: 40, 3: 20, 4: 10})
    y = 100 / 180
    assert (d1, d2, d3) == pytest.approx((1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))
    assert kneser_ney.discounts({}) == (0.5, 1.0, 1.5)


def test_perplexity_judges_against_trusted_text(spark):
    rng = random.Random(10)
    rows = [(i, sentence(rng, 150), rng.choice(["en", "de"]), "s") for i in range(300)] + [(1000 + i, "".join(rng.choices("qxzjkvw#$%&|QXZ", k=400)), "en", "s") for i in range(20)]
    rows += [(2000, None), (2001, ""), (2002, sentence(rng, 40), None, None), (2003, "é中" * 100, "xx", "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(1000 + i, 0, 0) for i in range(10)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in kneser_ney.judge_documents(frame(spark, rows), labels).collect()}
    assert len(found) == len(rows)
    assert np.mean([found[i].kept for i in range(300)]) > 0.96
    assert not any(found[1000 + i].kept for i in range(20))
    assert found[2000].perplexity is None and found[2000].kept is False and found[2001].kept is False
    assert found[2003].kept is False and found[2002].kept is True
    assert kneser_ney.judge_documents(frame(spark, []), labels).count() == 0
    unlabelled = kneser_ney.judge_documents(frame(spark, rows[:5]), labels.where("false")).collect()
    assert all(r.kept for r in unlabelled)


def test_licenses(spark):
    rng = random.Random(11)
    body = sentence(rng, 200)
    gpl = licenses.TEMPLATES["GPL-3.0-or-later"][0]
    rows = [
        (1, f"{body}\nReleased under the MIT License."), (2, f"{gpl} {body}"), (3, body), (4, f"{body}\nLICENSED  under the apache license;\nversion 2.0"),
        (5, f"é{body} {gpl.replace('published', 'issued')} x"), (6, None), (7, ""), (8, "Released under the MIT"), (9, " ".join(["Licensed under CC BY-NC 4.0."] * 2)),
        (10, f"{body} {gpl} {body} {gpl}"), (11, sentence(rng, 20_000) + " Released under the MIT License."), (1, f"{body}\nReleased under the MIT License."), (None, "Released under the MIT License."),
    ]
    found = licenses.scan_documents(frame(spark, rows)).collect()
    names = Counter((r.doc_id, r.license) for r in found)
    assert names[(1, "MIT")] == 2 and names[(None, "MIT")] == 1 and names[(11, "MIT")] == 1
    assert names[(2, "GPL-3.0-or-later")] == 1 and names[(10, "GPL-3.0-or-later")] == 2 and names[(5, "GPL-3.0-or-later")] == 1
    assert names[(4, "Apache-2.0")] == 1 and names[(9, "CC-BY-NC-4.0")] == 2
    assert not {3, 6, 7, 8} & {r.doc_id for r in found}
    texts = dict((r[0], r[1]) for r in rows)
    for r in found:
        if r.doc_id == 1:
            assert texts[1][r.start : r.end] == "Released under the MIT License"
        if r.doc_id == 5:
            assert texts[5][r.start : r.end].startswith("This program is free software") and 0.8 <= r.containment < 1
    assert licenses.scan_documents(frame(spark, [])).count() == 0


def test_licenses_against_brute_force(spark):
    """Notices edited at random: whatever a run of a template's length contains to nine tenths is found, and what is found is contained in a run a little longer."""
    rng = random.Random(12)
    templates = {n: [t for t in texts if len(t.split()) >= 12] for n, texts in licenses.TEMPLATES.items()}
    templates = {n: t for n, t in templates.items() if t}
    shingles = lambda ws: [" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)]
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    rows = []
    for i in range(150):
        notice = rng.choice(rng.choice(list(templates.values()))).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            notice[rng.randrange(len(notice))] = rng.choice(["other", "words", "here"])
        rows.append((i, " ".join([sentence(rng, rng.randint(0, 60)), *notice[: rng.choice([len(notice), len(notice), len(notice) * 3 // 4])], sentence(rng, rng.randint(0, 60))])))
    found = {}
    for r in licenses.scan_documents(frame(spark, rows).repartition(3), templates).collect():
        found.setdefault((r.doc_id, r.license), []).append(r.containment)
    must = 0
    for i, text in rows:
        own = shingles(plain(text))
        for name, texts in templates.items():
            best, loose = 0.0, 0.0
            for t in texts:
                wanted = set(shingles(plain(t)))
                for size, wide in ((len(wanted), False), (len(wanted) + 2 * (len(wanted) // 8 + 1), True)):
                    for at in range(max(1, len(own) - size + 1)):
                        share = len(wanted & set(own[at : at + size])) / len(wanted)
                        best, loose = (best, max(loose, share)) if wide else (max(best, share), loose)
            must += best >= 0.9
            assert best < 0.9 or (i, name) in found, (i, name, best)
            assert (i, name) not in found or (loose >= 0.8 and max(found[i, name]) <= loose + 1e-9)
    assert must >= 30
