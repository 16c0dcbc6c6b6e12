"""The corpus operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from framewright.llm import chunks, decontaminate, language, licenses, mixing, quality, simhash, substrings, token_counts, token_files, urls
from framewright.llm.queries import tokenizer_path

PLAIN, LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, row long, key string, words string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    """Nulls in any column, empty, short and long texts, repeated rows, near copies, clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéßü") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", ".\n", "."]) for _ in range(n))
    long_ = prose(9000)
    texts = [None, "", " \t\n", "one", "two words", "it's <|endoftext|> 12 34", "CC BY all Rights reserved", "General Public License\x00 cc　by cc by", "日本語 テキスト", "a  b\n\n c ", long_, long_ + " tail", *[prose(rng.randint(20, 300)) for _ in range(60)]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), 1, 2, "k", "w") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (500, texts[20], "en", "s1", None, None, None, None), (None, texts[21], None, None, 0, 0, "", ""), (None, None, None, None, 0, 0, "", "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_mixing(spark, docs, none, rows):
    out = mixing.plan_mix(docs).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len(PLAIN.findall(r[1] or ""))) for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    sums = {(r.source_size, round(r.target, 6)) for r in out}
    size, names = Counter(), sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    for r in rows:
        size[r[3]] += len(PLAIN.findall(r[1] or ""))
    goal, left, free = {}, 1.5 * sum(size.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while free:
        level = left / sum(free.values())
        full = [s for s, w in free.items() if level * w > 2 * size[s]]
        for s in full or list(free):
            goal[s] = 2 * size[s] if full else level * free[s]
            left -= goal[s]
            del free[s]
    assert sums == {(size[s], round(goal[s], 6)) for s in names}
    taken = Counter()
    for r in out:
        taken[round(r.target, 6)] += r.taken
    for s in names:
        assert abs(taken[round(goal[s], 6)] - goal[s]) <= max(0.02 * size[s], max(len(PLAIN.findall(r[1] or "")) for r in rows))
    assert got(mixing.plan_mix(docs.repartition(5)), "doc_id", "key", "taken") == Counter((r.doc_id, r.key, r.taken) for r in out)
    assert mixing.plan_mix(none).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_many_documents_come_near_the_target(spark):
    rng = random.Random(2)
    many = spark.createDataFrame([(i, "w " * rng.randint(0, 60), "big" if i % 3 else f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.plan_mix(many).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 60 for r in out)


def test_token_files(spark, docs, none, rows, tmp_path):
    path, folder = tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/ids"
    whole = chunks.load(path)
    manifest = token_files.write(docs, folder, path)
    out = sorted(token_files.read_back(manifest, folder).collect(), key=lambda r: r.start)
    ids = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows if r[0] is not None}
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in out:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(struct.pack(f"<{len(ids[r.doc_id])}I", *ids[r.doc_id])))
    assert token_files.read_documents(spark, manifest, folder, [5, 11]) == {5: ids[5], 11: ids[11]}
    assert token_files.token_files(none, path).count() == 0
    name = next((tmp_path / "ids").glob("*.zst"))
    raw = bytearray(name.read_bytes())
    raw[20] ^= 255
    name.write_bytes(raw)
    with pytest.raises(Exception, match=r"damaged|rror"):
        list(token_files.Reader(token_files._open(folder)[0], str(name)))


def test_token_counts_and_cache(spark, docs, none, rows, tmp_path):
    path, cache = tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    whole = chunks.load(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for _ in range(2):  # the second time all digests are stored
        assert got(token_counts.token_counts(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == want
        assert spark.read.parquet(cache).count() == spark.read.parquet(cache).select("digest").distinct().count()
    assert token_counts.token_counts(none, path).count() == 0
    piece = tokenizer_path("piece_bpe_32k.model")
    assert token_counts.token_counts(docs.limit(20), piece).count() == 20


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_separators_are_no_white_space_to_tokenizers(name):
    path = tokenizer_path(name)
    whole = chunks.load(path)
    memo = chunks.ChunkMemo(whole, list, lambda x: [i for y in x for i in y], name.startswith("byte"))
    rng = random.Random(1)
    texts = ["!!\x1c!!", "!\x1f!", "a\x1d b", *["".join(rng.choice("!a 1\x1c\x1d\x1e\x1f\n") for _ in range(12)) for _ in range(200)]]
    for text in texts:
        assert [i for ids in memo.of(text) for i in ids] == whole.encode(text, add_special_tokens=False).ids


def test_licenses(docs, none, rows):
    want = Counter()
    for r in rows:
        w = LETTERS.findall(lower(r[1]))
        hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in hits]
        want[r[0], len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    out = licenses.license_summary(docs)
    assert got(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert out.filter("score < 0 or score > 1").count() == 0
    assert licenses.license_summary(none).count() == 0


def test_a_changed_notice_is_still_found(spark):
    text = "x y Licensed under the new Apache License, Version 2.0 z"
    assert licenses.license_summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == "apache-2.0"


def test_urls(spark):
    seen = ["http://a.example.com/en/7x?y", "https://B.Example.NET/de/81", "ftp://x.net/de/1", "no scheme", None, "://", "http://org/es/", "http://www.spam-farm.example.org/q", "http://notexample.com/en", "http://com/en/#f", "http://a.org/es/1", "http://a.org/es/1"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(seen)] + [(None, "http://q.com/en/", None)], "page_id long, url string, host string")
    entries = spark.createDataFrame(urls.RULES + urls.LISTED, urls.ENTRIES)
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, entries).collect()}
    assert out[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert out[1] == ("b.example.net", "/de/81", "example.net/de/8", "block")
    assert out[2] == ("x.net", "/de/1", "net/de/", "allow")
    assert out[3] == out[4] == out[5] == ("", "", None, "allow")
    assert out[6] == ("org", "/es/", "org/es/", "block")
    assert out[7][2:] == (None, "block")
    assert out[8][2:] == (None, "allow")
    assert out[9] == ("com", "/en/", "com/en/", "block")
    assert out[None][2] == "com/en/"
    assert urls.judge(pages, entries).count() == 13
    assert urls.judge(pages, entries.limit(0)).filter("verdict = 'block'").count() == 0
    assert urls.judge(pages.limit(0), entries).count() == 0


def test_language(spark, docs, none, rows, sf_dir):
    out = language.identify(docs)
    assert got(out, "doc_id") == Counter((r[0],) for r in rows)
    blank = {r[0] for r in rows if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in out.collect() if r.lang_pred == "und"} - {None} == blank
    assert language.identify(none).count() == 0
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = language.identify(real).filter("held_out").join(real.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    pieces = language.Letters.get()
    whole = pieces.codes("Ab c  d1e" * 40)
    language.PIECE, old = 7, language.PIECE
    try:
        assert (pieces.codes("Ab c  d1e" * 40) == whole).all()
    finally:
        language.PIECE = old


def fingerprint(text):
    w = PLAIN.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_simhash(docs, none, rows):
    fps = [fingerprint(r[1]) for r in rows]
    root = components(fps)
    low = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in root}
    want = Counter((r[0], fp - (1 << 64) if fp >> 63 else fp, low[c]) for r, fp, c in zip(rows, fps, root, strict=True))
    assert got(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root))


def test_components_without_an_id_of_their_own_stay_apart(spark):
    rng = random.Random(3)
    prose = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(7)]
    ids = [None, None, None, 5, 5, 7]
    table = [*zip(ids, prose, strict=False), (None, prose[0]), (7, prose[3]), (8, prose[4]), (None, prose[6])]
    fps = [fingerprint(t) for _, t in table]
    root = components(fps)
    assert len(set(root)) == 7
    kept = [(r.doc_id, r.text) for r in simhash.deduplicate(spark.createDataFrame(table, "doc_id long, text string")).collect()]
    assert Counter(kept) == Counter([(None, prose[0]), (None, prose[1]), (None, prose[2]), (5, prose[3]), (5, prose[4]), (7, prose[5]), (None, prose[6])])


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_connect_all_that_they_should(spark, crowd):
    rng = random.Random(1)
    base, fps = [rng.getrandbits(64) for _ in range(20)], set()
    for _ in range(300):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"), crowd).collect()
    place = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))
    for e in edges:
        a, b = e.a & (1 << 64) - 1, e.b & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 2
        a, b = root[place[a]], root[place[b]]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == components(fps)


def test_golay_keys_meet_within_two_errors():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 3000)
    b = a ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    x, y = simhash.golay_keys(a), simhash.golay_keys(b)
    assert ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any((1, 2)).all()


def test_quality(docs, none, rows, spark, sf_dir):
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = PLAIN.findall(t)
        seen, cover = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if PLAIN.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert got(quality.quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality.quality(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality.quality(real).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged]) > 0.95


def test_repeated_words_are_counted_once(spark):
    text = "a b c d a b c x a b c " + "q " * 5
    w = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.quality(w).first().n_repeat_words == 14


def test_decontamination(spark, docs, none, rows):
    long_ = rows[10][1]
    items = [(1, " ".join(long_.split()[100:140])), (2, "two words"), (3, None), (4, ""), (None, "one"), (2, "CC by ALL"), (10, " ".join(long_.split()[105:116])), (5, "never seen anywhere")]
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    wins = {}
    for item, text in items:
        w = LETTERS.findall(lower(text))
        for i in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    want = Counter()
    for r in rows:
        w, hit, named = LETTERS.findall(lower(r[1])), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    named |= wins[tuple(w[i : i + n])] - {None}
        ids = sorted(map(str, named))
        want[r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.decontaminate(docs, bench), *columns) == want
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.count() == sum(n for k, n in want.items() if not k[-1])


def test_proximity_finds_a_changed_phrase(spark):
    docs = spark.createDataFrame([(1, "a q w e r t y new u i o p z"), (2, "p o i u y t r e w q")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "q w e r t y u i o p")], "item_id long, text string")
    wins = decontaminate.windows(bench)
    postings = decontaminate.index(docs, wins.selectExpr("explode(terms) AS term").distinct()).cache()
    order = decontaminate.ranked(wins, postings)
    assert decontaminate.phrases(order, postings).count() == 0
    assert {r.row for r in decontaminate.proximity(order, postings, slop=1).collect()} == {r.row for r in postings.filter("pos = -1 and doc_id = 1").collect()}


def test_substrings(spark, docs, none, rows):
    rng = random.Random(9)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)).capitalize() + ". "
    shared = "".join(sentence() for _ in range(6))
    texts = ["".join(sentence() for _ in range(5)) + (shared if i % 2 else "") + "".join(sentence() for _ in range(5)) for i in range(10)]
    table = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans long")
    out = {r.doc_id: r.text for r in substrings.deduplicate(table).collect()}
    assert out == {i: t if i % 2 == 0 or i == 1 else t.replace(shared, "") for i, t in enumerate(texts)}
    assert all("".join(substrings.sentences(r[1] or "")) == (r[1] or "") for r in rows)
    kept = substrings.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows)
    assert kept.filter("text is null").count() == sum(r[1] is None for r in rows)
    assert substrings.deduplicate(none).count() == 0
    twice = spark.createDataFrame([(5, "x " + shared, 0), (5, "y. " + shared, 0), (None, shared, 0), (7, shared + shared, 0), (7, shared + shared, 0)], "doc_id long, text string, spans long")
    left = [(r.doc_id, r.text) for r in substrings.deduplicate(twice).collect()]
    assert sum(shared[60:] in (t or "") for _, t in left) == 1 and all(t.count(shared[60:]) <= 1 for _, t in left)
    assert [t for d, t in left if d in (7, None)] == ["", "", ""]


def test_nearly_quoted_passages_are_found_and_dropped(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n)]
    item, short, again = words(14), words(4), ["ha"] * 6 + ["no"] * 4
    common = [*item[:6], *words(3), *item[7:]]
    texts = {0: words(40), 1: [*words(8), *item, *words(8)], 2: [*item[2:10], *words(9)], 3: [*words(9), *short, *words(2)], 4: item[:7], 5: [*words(3), *short[:2], *words(5), *short[2:], *words(9)]}
    for k in range(14):
        changed = list(item)
        changed[k] = "zzz"
        texts[10 + k] = [*words(5), *changed, *words(5)]
        texts[30 + k] = [*words(5), *item[:k], "zzz", *item[k:], *words(5)]
        texts[50 + k] = [*words(5), *item[:k], *item[k + 1 :], *words(5)]
    texts[70] = [*words(5), *[w if i % 9 else "zzz" for i, w in enumerate(item)], *words(5)]
    texts[71] = [*words(5), *[w if i % 3 else "zzz" for i, w in enumerate(item)], *words(5)]
    texts[72] = [*words(5), *again[:5], "zzz", *again[6:], *words(5)]
    table = spark.createDataFrame([(d, " ".join(t), "x") for d, t in texts.items()] + [(None, " ".join(common), "x")], "doc_id long, text string, _x string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (None, " ".join(item)), (3, "never seen before"), (4, " ".join(again))], "item_id long, text string")
    wins = [item[i : i + 10] for i in range(5)] + [short, "never seen before".split(), again]

    def brute(text):
        for w in wins:
            for s in range(-10, len(text)):
                places = [[p for p in range(max(0, s + o - 3), s + o + 4) if p < len(text) and text[p] == x] for o, x in enumerate(w)]
                if sum(map(bool, places)) >= 0.8 * len(w) and any(s + o in p for o, p in enumerate(places)):
                    return True
        return False

    out = {r.doc_id: r for r in decontaminate.decontaminate(table, bench).collect()}
    assert {d: r.near for d, r in out.items()} == {d: brute(t) for d, t in texts.items()} | {None: brute(common)}
    assert not out[0].near and not out[4].near and not out[5].near and not out[71].near
    assert all(out[d].near and out[d].near_items == 1 for d in (1, 2, 3, *range(10, 24), *range(30, 44), 70, 72))
    assert {r.doc_id for r in decontaminate.drop_contaminated(table, bench).collect()} == {d for d, r in out.items() if not r.near}


def test_runs_cover_what_all_runs_cover(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + ". "
    whole = [sentence(n) for n in (25, 12, 10, 8)]
    uneven = [[sentence(rng.choice([1, 2, 3, 8, 12, 25])) for _ in range(rng.randint(2, 9))] for _ in range(6)]
    lists = [[sentence(9), *whole, sentence(9)], whole, whole, [sentence(7), *whole]]
    lists += [[sentence(rng.randint(1, 30)), *rng.choice(uneven), sentence(rng.randint(1, 30)), *rng.choice(uneven)] for _ in range(20)]
    seen, gone = {}, [[False] * len(x) for x in lists]
    for d, x in enumerate(lists):
        for i in range(len(x)):
            for j in range(i + 2, len(x) + 1):
                run = "".join(x[i:j])
                if len(run.split()) >= 20 and seen.setdefault(run, (d, i)) != (d, i):
                    gone[d][i:j] = [True] * (j - i)
    table = spark.createDataFrame([(d, "".join(x)) for d, x in enumerate(lists)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in substrings.deduplicate(table).collect()}
    assert out == {d: "".join(s for s, g in zip(x, gone[d], strict=True) if not g) for d, x in enumerate(lists)}
    assert out[1] == out[2] == ""


def test_passages_inside_sentences_share_runs():
    rng = random.Random(6)
    words = lambda n: [rng.choice(["", "\n" * (rng.random() < 0.01)]) + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    share = []
    for k in range(600):
        passage = words(51 if k % 2 else 42)
        if k % 3 == 0:  # two sentences of 27 words
            passage = [*words(26), words(1)[0] + ".", *words(26), words(1)[0] + "."]
        texts = [words(rng.randint(0, 60)) + passage + words(rng.randint(0, 60)) for _ in range(2)]
        joined = [rng.choice([" ", "  ", "\t"]).join(t) for t in texts]
        found = [{h: (i, n) for i, n, h in substrings.runs(t)} for t in joined]
        common = set(found[0]) & set(found[1])
        assert common
        parts = substrings.sentences(joined[0])
        assert "".join(parts) == joined[0]
        assert max(len(p.split()) for p in parts) <= substrings.EVERY
        gone = set().union(*(range(i, i + n) for i, n in (found[0][h] for h in common)))
        share.append(sum(len(parts[i].split()) for i in gone) / len(passage))
    assert max(share) <= 1
    assert np.mean(share) > 0.8


def test_cuts_are_the_first_least_of_any_window():
    rng = random.Random(7)
    for _ in range(300):
        w = [bytes([rng.randint(97, 99)]) for _ in range(rng.randint(0, 40))]
        marks = list(map(zlib.crc32, w))
        want = {marks.index(min(marks[i : i + substrings.EVERY]), i) for i in range(1, len(w) - substrings.EVERY + 1)}
        assert substrings.cuts(w) == sorted(want)


def test_pipeline(spark, sf_dir):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.count()
    ids = [r.doc_id for r in corpus.STAGES[4][1](spark, docs, sf_dir).orderBy("start").collect()]
    assert ids == sorted(r.doc_id for r in docs.collect())
    assert corpus.run(spark, sf_dir).count() == len(ids)
