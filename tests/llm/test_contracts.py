"""Results of whole operators against brute force, and the cases that texts are lost or invented by."""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from framewright.llm import common, decontaminate, language, licenses, mixing, quality, simhash, substrings, token_counts, token_files, urls
from framewright.llm.queries import tokenizer_path

PLAIN, LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def clashing(spark, rows):
    """Texts with columns that are named like the operators' own."""
    names = "doc_id long, text string, source string, _id long, _k string, _key long, _copies int, row long, n long, rank int, copies long, _fw_row long, _fw_id string, _fw_key long, h long, words string"
    return spark.createDataFrame([(d, t, s, 1, "k", 2, 3, 4, 5, 6, 7, 8, "f", 9, 10, "w") for d, t, s in rows], names)


def words_taken(df):
    out = Counter()
    for r in df.collect():
        out[r.source] += len(PLAIN.findall(r.text or ""))
    return out


def test_repeated_rows_are_mixed_whole(spark):
    rng = random.Random(3)
    rows = [(7, "a " * 10, "one")] * 100 + [(None, "b c", "two")] * 41 + [(i, prose(rng, rng.randint(1, 30)), "two") for i in range(60)] + [(7, "a " * 10, None)] * 5 + [(9, None, "two")] * 3
    docs = clashing(spark, rows).repartition(4)
    plan = mixing.plan_mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((d, len(PLAIN.findall(t or ""))) for d, t, _ in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken, want = words_taken(mixed), Counter()
    for r in plan:
        want[r.source_size] += r.taken
    size = words_taken(docs)
    assert {size[s]: taken[s] for s in size} == {k: v for k, v in want.items()}
    target = {r.source_size: r.target for r in plan}
    assert all(abs(taken[s] - target[size[s]]) <= 30 for s in size)
    assert words_taken(mixing.mix(docs.repartition(3))) == taken


def test_repeated_rows_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "a b", "s")] * 50 + [(i, "c", "s") for i in range(20)], "doc_id long, text string, source string")
    whole = Counter((r.doc_id, r.taken) for r in mixing.plan_mix(docs).collect())
    monkeypatch.setattr(mixing, "SLICE", 8)
    assert Counter((r.doc_id, r.taken) for r in mixing.plan_mix(docs).collect()) == whole


def test_expected_copies_are_target_by_size(spark):
    """Many sources of one make-up: heavy and light documents are taken as often as the target asks."""
    sizes = [300, 40, 40, 30, *[9] * 20, *[5] * 30]
    rows = [(1000 * s + i, "w " * n, f"s{s}") for s in range(500) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan_mix(docs, weights=(1,), share=1.3).collect()
    mean = defaultdict(list)
    for r in out:
        mean[r.size].append(r.copies)
    for n, got in mean.items():
        assert abs(np.mean(got) - 1.3) < 4 * np.sqrt(0.25 / 500) * (1 if n > 9 else 0.5), n


def test_stages_keep_columns_that_clash(spark):
    rng = random.Random(5)
    texts = [prose(rng, 90) for _ in range(6)]
    rows = [*enumerate(texts), (6, texts[0]), (None, texts[1]), (None, None), (8, "")]
    docs = clashing(spark, [(d, t, "s") for d, t in rows])
    bench = spark.createDataFrame([(1, " ".join(texts[2].split()[5:25]), 0, 0)], "item_id long, text string, _fw_row int, _key int")
    for out in (simhash.deduplicate(docs), decontaminate.drop_contaminated(docs, bench), quality.keep_good(docs.drop("_fw_row", "_fw_id", "_fw_key")), mixing.mix(docs)):
        assert set(out.columns) <= set(docs.columns) and len(out.columns) >= len(docs.columns) - 3
        assert all(r._k == "k" and r._copies == 3 and r.n == 5 for r in out.collect())
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect() if r.doc_id is not None) == [0, 1, 3, 4, 5, 6, 8]
    assert simhash.deduplicate(docs).count() == 7  # null and empty texts are one fingerprint


def test_broadcasts_are_measured_in_bytes(spark):
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) AS t", "sequence(0, 999) AS a", "transform(sequence(0, 9), x -> named_struct('p', x, 'q', id)) AS s")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.few(wide, 10))
    assert not hinted(common.few(wide, 9))
    assert not hinted(common.few(wide, 10, 10_000))


def test_probes_know_all_of_theirs(spark):
    from pyspark.sql import functions as F

    known = spark.range(3000).select(F.xxhash64("id").alias("h"))
    for most in (1 << 22, 1 << 10):
        test = common.probe(known, "h", most)
        assert known.filter(test(F.col("h"))).count() == 3000
    assert spark.range(10000, 20000).filter(common.probe(known, "h")(F.xxhash64("id"))).count() < 2500
    assert known.filter(common.probe(known.limit(0), "h")(F.col("h"))).count() == 0


def spans_by_hand(words):
    """(label, exact, first, last, cover, verified) of every span, from all pairs of places."""
    out = []
    groups = [(True, t, x) for t, x in licenses.PHRASES.items()] + [(False, t, x) for t, x in licenses.NOTICES.items()] + [(False, t, x) for x, t in licenses.TEXTS.items()]
    for exact, text, label in groups:
        t = licenses.words_of(text)
        k = 2 if exact or len(t) < 40 else 5
        grams = defaultdict(list)
        for j in range(len(t) - k + 1):
            grams[tuple(t[j : j + k])].append(j)
        lines = defaultdict(list)
        for i in range(len(words) - k + 1):
            for j in grams.get(tuple(words[i : i + k]), ()):
                lines[i - j].append((i, j))
        n = len(t) - k + 1
        seeds = sorted(d for d, hits in lines.items() if (len(hits) == n if exact else len(hits) >= 0.25 * n))
        parts = []
        for d in seeds:
            if parts and not exact and d - parts[-1][-1] <= 3:
                parts[-1].append(d)
            else:
                parts.append([d])
        for part in parts:
            hits = [h for d in part for h in lines[d]]
            low, stop = min(i for i, _ in hits), max(i for i, _ in hits) + k
            cover = len({j + x for _, j in hits for x in range(k)}) / len(t)
            out.append((label, exact, low, stop - 1, cover, cover >= 0.8 and stop - low <= len(t) / 0.8 + 3))
    return out


def test_license_spans_by_brute_force(spark, sf_dir):
    rng = random.Random(4)
    texts = [None, "", "cc", "cc by", "CC by cc BY", *(f"{prose(rng, 30)} {t}. {prose(rng, 20)}" for t in [*licenses.NOTICES, *licenses.TEXTS.values()])]
    for t in [*licenses.NOTICES, *licenses.TEXTS.values()]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(["", "new", "brand new", w[0]])
            texts.append(f"{prose(rng, 5)} {' '.join(w)} {t if rng.random() < 0.3 else ''}")
    texts += [" ".join(rng.choice(" ".join(licenses.NOTICES).split()) for _ in range(200)) for _ in range(10)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    summary = {r.doc_id: r for r in licenses.license_summary(docs).collect()}
    for d, t in enumerate(texts):
        w = LETTERS.findall(lower(t))
        want = spans_by_hand(w)
        assert found[d].n_words == len(w)
        assert Counter((s.label, s.exact, s.first_word, s.last_word, round(s.cover, 9), s.verified) for s in found[d].spans) == Counter((*s[:4], round(s[4], 9), s[5]) for s in want)
        assert summary[d].labels == ",".join(sorted({s[0] for s in want if s[5]}))
        assert abs(summary[d].score - max((s[4] for s in want), default=0)) < 1e-9
    at = 5 + len(licenses.NOTICES)
    for k, label in enumerate([*licenses.NOTICES.values(), *licenses.TEXTS]):
        assert label in summary[5 + k].labels.split(",")
        if 5 + k >= at:  # whole license texts are found with a word changed
            assert all(label in summary[at + len(licenses.TEXTS) + 3 * k + x].labels.split(",") for x in range(3))


@pytest.mark.parametrize("in_plan", [1 << 14, 0])
def test_url_lists(spark, tmp_path, monkeypatch, in_plan):
    monkeypatch.setattr(urls, "IN_PLAN", in_plan)
    rng = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "x.org", "org", "q.b.a.com"]
    entries = {(rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4))), rng.choice(["rule", "listed"])): rng.choice(["allow", "block"]) for _ in range(30)}
    entries[("com", "/ab", "rule")] = "block"
    table = [(h, p, v, k) for (h, p, k), v in entries.items()] + [("com", "/ab", "allow", "rule"), (None, "/", "block", "rule"), ("a/b.com", "/", "block", "rule"), ("x.org", None, "block", "listed"), ("org", "/", "block", None)]
    pages = [(i, f"http://{rng.choice(hosts).upper()}/{''.join(rng.choice('ab/?') for _ in range(rng.randint(0, 6)))}") for i in range(200)]
    out = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(table, urls.ENTRIES)).collect()}
    for i, url in pages:
        host, path = re.match(r"http://([^/?#]*)([^?#]*)", url).groups()
        host = lower(host)
        fit = [(len(h + p), h + p, v, k) for (h, p, k), v in entries.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rules = max((x for x in fit if x[3] == "rule"), default=None)
        assert out[i] == ((rules[1], rules[2]) if rules else (None, "block" if any(x[3] == "listed" for x in fit) else "allow"))
    (tmp_path / "list.txt").write_text("# spam\nhttp://Spam.Example.org:8080/a?b#c\n\n! more\nbad.example.com # remark\n")
    assert sorted(tuple(r) for r in urls.read_list(spark, f"file://{tmp_path}/list.txt").collect()) == [("bad.example.com", "/", "block", "listed"), ("spam.example.org", "/a", "block", "listed")]


def test_token_files_of_hot_ids(spark, tmp_path):
    rng = random.Random(6)
    path, folder = tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/ids"
    rows = [(5, "same text")] * 60 + [(5, prose(rng, 9)) for _ in range(40)] + [(None, prose(rng, 9)) for _ in range(50)] + [(i, prose(rng, rng.randint(0, 20))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = sum(len(t.encode()) for _, t in rows)
    manifest = token_files.write(docs, folder, path, least=size // 12, most=size // 12)
    files = manifest.orderBy("file").collect()
    assert len(files) > 8 and max(f.n_docs for f in files) < 60
    assert sum(f.low <= 5 <= f.high for f in files) > 3 and sum(f.low == token_files.NO_ID for f in files) > 1
    out = sorted(token_files.read_back(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    whole = token_files.chunks.load(path)
    ids = [(d, [*whole.encode(t, add_special_tokens=False).ids, 2]) for d, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for d, x in ids)
    assert all(b.start == a.start + a.n_tokens for a, b in pairwise(out))


def test_sentencepiece_counts_whole_texts(spark):
    import sentencepiece

    rng = random.Random(2)
    path = tokenizer_path("piece_bpe_32k.model")
    made = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", " ", "a\n\nb  c", "日本語 テキスト", "<s> x </s>", *[prose(rng, 40) for _ in range(10)]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == {i: len(made.encode(t or "")) for i, t in enumerate(texts)}


def test_substrings_by_brute_force_over_all_runs(spark, sf_dir):
    rng = random.Random(1)
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [*sample, (900, sample[3][1]), (901, (sample[5][1] or "")[:2000] + " " + prose(rng, 30)), (902, None), (903, ""), (904, prose(rng, 200) + " ... *** !!\n&&& ? ."), (905, "*** ... " + prose(rng, 60) + "! &&& ! ***")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = {d: substrings.sentences(t or "") for d, t in rows}
    words = {d: [LETTERS.findall(lower(p)) for p in ps] for d, ps in parts.items()}
    first, gone = {}, {d: set() for d, _ in rows}
    for d in sorted(parts):
        n = len(parts[d])
        for i in range(n):
            size, key = 0, []
            for j in range(i, n) if words[d][i] else ():
                size += len(words[d][j])
                key += [" ".join(words[d][j])] if words[d][j] else []
                if words[d][j] and len(key) > 1 and size >= substrings.WORDS:
                    joined = " ".join(key)
                    if first.setdefault(joined, (d, i)) != (d, i):
                        gone[d] |= set(range(i, j + 1))
    out = {r.doc_id: r for r in substrings.removal(docs).collect()}
    for d, t in rows:
        kept = None if t is None else "".join(p for i, p in enumerate(parts[d]) if i not in gone[d])
        assert (d, out[d]._fw_cut.text) == (d, kept)
        assert out[d]._fw_cut.n_removed == len(gone[d])
    assert not gone[904] and not gone[905]


def test_languages_by_whole_vectors(spark, sf_dir):
    """Prototypes and texts as the vectors that the operator never builds."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()] + [(None, "été où ça", "fr"), (1000, None, "en"), (1001, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    letters = language.Letters.get()

    def vector(text):
        c = letters.codes(text or "")
        return letters.vectors(c).astype(float).sum(0) if len(c) else np.zeros(language.DIMS), len(c)

    held = {d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    sums = defaultdict(lambda: np.zeros(language.DIMS))
    for d, t, lang in rows:
        v, n = vector(t)
        if not held[d] and lang is not None and t is not None and n:
            sums[lang] += v / n
    names = sorted(sums)
    protos = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    protos -= protos.mean(0)
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    for r in language.identify(docs).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        v, n = vector(text)
        assert r.held_out == held[r.doc_id]
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cos = protos @ v
        assert r.lang_pred == names[int(np.argmax(cos))]
        assert abs(r.score - max(cos.max(), 0) / np.maximum(cos, 0).sum()) < 1e-5


RULES = {
    "length": (lambda s: s["n_words"], (80, np.inf), (50, np.inf)),
    "symbols": (lambda s: s["n_symbols"] / s["n_words"] if s["n_words"] else None, (0, 0.05), (0, 0.2)),
    "symbol_chars": (lambda s: s["n_symbols"] / s["word_chars"] if s["word_chars"] else None, (0, 0.02), (0, 0.1)),
    "word_length": (lambda s: s["word_chars"] / s["n_words"] if s["n_words"] else None, (3, 9), (2, 15)),
    "repeats": (lambda s: s["n_repeat_words"] / s["n_words"] if s["n_words"] else None, (0, 0.2), (0, 0.4)),
    "lines": (lambda s: s["n_dup_lines"] / s["n_lines"] if s["n_lines"] else None, (0, 0.1), (0, 0.4)),
    "shouts": (lambda s: s["n_shouts"] / s["n_words"] if s["n_words"] else None, (0, 0.02), (0, 0.2)),
    "stops": (lambda s: s["n_stops"] / s["n_words"] if s["n_words"] else None, (0.01, 0.4), (0.004, 0.6)),
}


def kept_by_hand(rows):
    """The verdicts of weak supervision: statistics, votes and EM over documents, not over patterns."""
    stats = []
    for _, text in rows:
        t = text or ""
        w = PLAIN.findall(t)
        seen, cover = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if PLAIN.search(x)]
        stats.append({"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines), "n_shouts": t.count("!!"), "n_stops": t.count(".")})
    votes = np.zeros((len(rows), len(RULES)), int)
    for i, s in enumerate(stats):
        for k, (value, good, bad) in enumerate(RULES.values()):
            x = value(s)
            votes[i, k] = 0 if x is None else 1 if good[0] <= x <= good[1] else -1 if x < bad[0] or x > bad[1] else 0
    p = np.where((votes == -1).any(1), 0.02, 0.98)
    for _ in range(quality.ROUNDS):
        share = (p.sum() + 9) / (len(p) + 10)
        odds = np.full(len(p), np.log(share / (1 - share)))
        for k in range(votes.shape[1]):
            for v in (-1, 0, 1):
                on = votes[:, k] == v
                odds += np.where(on, np.log((p[on].sum() + 1) / (p.sum() + 3)) - np.log(((1 - p[on]).sum() + 1) / ((1 - p).sum() + 3)), 0)
        p = 1 / (1 + np.exp(-odds))
    failed = [s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"] for s in stats]
    return [not f and q >= 0.5 for f, q in zip(failed, p, strict=True)], p


def test_quality_verdicts_by_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(None, None), (-1, ""), (-2, "!! " * 90), (-3, "# $ " * 60)]
    kept, p = kept_by_hand(rows)
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (d, _), k, q in zip(rows, kept, p, strict=True):
        assert out[d].kept == k
        assert abs(out[d].posterior - q) < 1e-6


def fingerprint(text):
    import xxhash

    w = PLAIN.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_long_texts_are_hashed_in_pieces():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 50, 400):
        text = prose(rng, n)
        for piece in (1, 5, 17, 1 << 20):
            assert simhash._fingerprint(text.encode(), piece=piece) == fingerprint(text)


def test_pipeline_by_brute_force(spark, sf_dir):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [r for r, k in zip(rows, kept_by_hand(rows)[0], strict=True) if k]
    stage = dict(corpus.STAGES)
    good = stage["quality"](spark, docs, sf_dir)
    assert Counter((r.doc_id, r.text) for r in good.collect()) == Counter(kept)
    fps = [fingerprint(t) for _, t in kept]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(kept):
        least[find(i)] = min(d, least.get(find(i), d))
    unique = stage["near_duplicates"](spark, good, sf_dir)
    assert Counter(r.doc_id for r in unique.collect()) == Counter(least.values())
    texts = {d: LETTERS.findall(lower(t)) for d, t in kept if d in set(least.values())}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = LETTERS.findall(lower(r.text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    exact = {d for d, w in texts.items() if any(tuple(w[i : i + 10]) in windows for i in range(max(1, len(w) - 9)))}
    clean = stage["decontamination"](spark, unique, sf_dir)
    left = {r.doc_id for r in clean.collect()}
    near = {r.doc_id for r in decontaminate.decontaminate(unique, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("near").collect()}
    assert exact <= near and left == set(texts) - near
    mixed = stage["mix"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= left
    plan = mixing.plan_mix(clean).collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in plan if r.copies})


def test_pipeline_on_odd_tables(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    texts = [prose(rng, 120).replace("a ", "a. ") for _ in range(12)]
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)] + [(None, texts[3], "s"), (None, prose(rng, 99).replace("b ", "b. "), None), (3, None, "s"), (4, "", None), (5, texts[5], "s"), (5, texts[5], "s")]
    names = [n for n in clashing(spark, []).columns if not n.startswith("_fw_")]
    for name, docs in (("odd", clashing(spark, rows).select(names)), ("none", clashing(spark, []).select(names))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (None, texts[7])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = [r.doc_id for r in corpus.run(spark, folder).collect()]
        assert set(out) <= {None, *range(12)} - {7}
        assert bool(out) == (name == "odd")
