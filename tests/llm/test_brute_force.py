"""Operators against plain versions over whole tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from noticegrid.llm import (
    bpe, exact_dedup, license_scan, near_dup, packing, repetition, secret_scan, shingles, token_counts,
)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_token_counts(documents, texts, library):
    for r in token_counts.token_counts(documents).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(ids), len(texts[r.doc_id].encode()), len(ids) > 2048)


def test_merging_on_hard_texts(library):
    vocab = bpe.vocabulary(bpe.default_path())
    rng = np.random.default_rng(4)
    pool = [chr(c) for c in [*range(1, 0x300), *range(0x370, 0x600), 0x1C89, 0x2028, 0x3000, 0xAC00, 0x10400, 0x1F600, 0x105C0]]
    pool += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", "aaaa", "́"]
    hard = ["", "aaaaaaaaaaaaaaa" * 40, "!" * 3000, "a<|endoftext|>b"] + ["".join(rng.choice(pool, rng.integers(1, 30))) for _ in range(3000)]
    for text in hard:
        chunks = vocab.chunks(text)
        got = np.concatenate(vocab.encode(chunks)).tolist() if chunks else []
        assert got == library.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("limit", [40, 100_000])
def test_held_symbols_on_hard_texts(library, limit):
    """Texts cut in Arrow's buffers, with a cache that forgets all the time and one that never does."""
    vocab = bpe.vocabulary(bpe.default_path())
    known, rng = bpe.ChunkCache(vocab, limit), np.random.default_rng(5)
    pool = [chr(c) for c in [*range(1, 0x300), *range(0x370, 0x600), 0x1C89, 0x2028, 0x3000, 0xAC00, 0x10400, 0x1F600, 0x105C0]]
    pool += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", " ", " ", "\n", "aaaa", "\u0301", "word", "Word,"]
    wide = ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(1500)]
    plain = ["", " ", "\n\t", "a<|endoftext|>b", "aaaa" * 300, *("".join(rng.choice([c for c in pool if c.isascii()], rng.integers(0, 40))) for _ in range(1500))]
    for texts in [wide[i:i + 100] for i in range(0, 1500, 100)] + [plain[i:i + 100] for i in range(0, 1500, 100)]:
        chunks, place, starts = bpe.split(pa.array(texts))
        ids, first, size = known.encode(chunks)
        for text, a, b in zip(texts, starts[:-1], starts[1:]):
            got = bpe.gathered(ids, first[place[a:b]], size[place[a:b]]).tolist()
            assert got == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packing(documents, texts, library):
    rows = packing.pack(documents).collect()
    ids = {d: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for d, t in texts.items()}
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert r.length == len(piece) > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
        cover[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in texts:
        at = 0
        for start, length in sorted(cover[d]):
            assert start == at
            at += length
        assert at == len(ids[d])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_bm25_scores_match_the_formula():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(30)]
    index = packing.ShardIndex(docs, common=1.0)
    df = defaultdict(int)
    for d in docs:
        for t in set(d.tolist()):
            df[t] += 1
    mean = np.mean([len(d) for d in docs])
    for seed in range(30):
        want = []
        for d in docs:
            total = 0.0
            for t in set(docs[seed].tolist()) & set(d.tolist()):
                tf = (d == t).sum()
                if df[t] > 1:
                    total += np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            want.append(total)
        assert np.allclose(index.scores(seed), want)


def test_packing_brings_interleaved_subjects_together(spark):
    topics = ("river water flood", "court judge verdict", "violin concert opera", "engine piston diesel", "wheat harvest barley")
    rows = [(i, f"{topics[i % 5]} the and of to in " * 4) for i in range(200)]
    subjects = defaultdict(set)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), size=128, shard_docs=40).collect():
        subjects[r.sequence_id].add(r.doc_id % 5)
    assert sum(len(s) == 1 for s in subjects.values()) >= 0.8 * len(subjects)


def test_corpus_statistics_and_routes(spark):
    ids = [[3, 3, 5], [3, 7], [3, 7, 7, 9], [3]]
    tokens = spark.createDataFrame([(i, np.array(x, "<u2").tobytes()) for i, x in enumerate(ids)], "doc_id bigint, ids binary").repartition(3)
    corpus = packing.corpus_of(tokens, "<u2", 9)
    assert corpus.df.tolist() == [0, 0, 0, 4, 0, 1, 0, 2, 0, 1] and corpus.count == 4 and corpus.mean == 2.5
    assert [corpus.routes(np.array(x), corpus.shared()) for x in ids] == [(3, -1), (7, 3), (7, 3), (3, -1)]


def test_windows_use_every_document_once_and_prefer_neighbours():
    rng = np.random.default_rng(3)
    docs = [rng.integers(100 * (i % 2), 100 * (i % 2) + 90, 40) for i in range(20)]
    first = next(packing.windows(docs, 200))
    assert {d % 2 for d, _, _ in first} == {0}  # the seed's own vocabulary
    used = sorted((d, s, n) for w in packing.windows(docs, 64) for d, s, n in w)
    assert sum(n for *_, n in used) == sum(map(len, docs)) and len({(d, s) for d, s, _ in used}) == len(used)


def test_repetition(documents, texts):
    for r in repetition.repetition(documents).collect():
        text = texts[r.doc_id]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        at = defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i:i + 5])].append(i)
        repeat = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
            seen.add(line)
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), dup, len(repeat), failed)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and not (failed and r.kept)
        assert r.chars_dup_5 == sum(len(words[i]) for i in repeat)


def test_secret_base_spans(documents, texts):
    kinds = {
        "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
    }
    for r in secret_scan.secrets(documents).collect():
        spans = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in pattern.finditer(texts[r.doc_id]):
                if len(m[2] if kind == "assign" else m[0]) >= (12, 18, 16)[k]:
                    spans.append((m.start(), k, m.end(), kind))
        base = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_network_gradients_and_learning():
    rng = np.random.default_rng(0)
    net = secret_scan.Network()
    codes, y = rng.integers(0, 128, (6, 20)), np.array([0, 1, 1, 0, 1, 0.0])
    loss = lambda: float(np.mean(np.logaddexp(0, net.margins(codes)) - y * net.margins(codes)))
    for p, g in zip(net.params(), net.gradients(codes, y)):
        at = tuple(rng.integers(0, s) for s in p.shape)
        if p is net.embed:
            at = (int(codes[0, 3]), 2)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(150)]
    plain = [f"10.{a}.{b}.{c}" for a, b, c in rng.integers(10, 250, (150, 3))]
    cut = secret_scan.codes_of([secret_scan.windows(f"see {w} here", 4, 4 + len(w))[0] for w in hexes + plain])
    y = np.repeat([1.0, 0.0], 150)
    test = np.arange(300) % 5 == 0
    fitted = secret_scan.fit_network(cut[~test], y[~test])
    margins = fitted.margins(cut[test])
    limit = secret_scan.calibrate(margins, y[test], 0.95)
    assert ((margins >= limit) == (y[test] > 0)).mean() > 0.95
    assert secret_scan.calibrate(margins, np.zeros(len(margins)), 0.95) == float("inf")


def test_network_adds_what_the_patterns_miss(spark, documents):
    extra = [(10**9 + i, "Bearer " + hashlib.sha1(str(i).encode()).hexdigest()[:15] + "Z" + hashlib.sha1(str(i).encode()).hexdigest()[:15]) for i in range(20)]
    more = []  # findings of the patterns to learn from
    for i in range(300):
        h = hashlib.sha1(f"{i}a".encode()).hexdigest()
        more.append((2 * 10**9 + i, f"the key token = \"{h}\" and host 10.{i % 250}.7.{i % 99}33 again"))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra + more, "doc_id bigint, text string"))
    rows = {r.doc_id: r for r in secret_scan.secrets(docs).collect()}
    assert sum(rows[d].n_net for d, _ in extra) >= 15
    assert sum(rows[d].n_net for d, _ in more) <= 15


def test_rare_findings_are_learnt_from_whatever_their_ids(spark):
    from pyspark.sql import functions as F

    last = {r.id for r in spark.range(13_000).orderBy(F.xxhash64("id").desc()).limit(60).collect()}
    rows = []
    for i in range(13_000):
        h = hashlib.sha1(f"{i}b".encode()).hexdigest()
        rows.append((i, f"the key token = \"{h[:30]}\" again" if i in last else f"call 10.{i % 250}.{i % 199}.{i % 99}33 today"))
    rows += [(10**6 + i, f"Bearer {hashlib.sha1(str(i).encode()).hexdigest()[:15]}Z{hashlib.sha1(str(-i).encode()).hexdigest()[:15]}") for i in range(20)]
    found = {r.doc_id: r.n_net for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(found[10**6 + i] for i in range(20)) >= 15
    assert sum(found[i] for i in range(13_000)) <= 130


def test_secrets_without_digits_are_candidates_and_plain_words_are_not_secrets(spark):
    rng = np.random.default_rng(6)
    key = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 24))
    word = lambda: "".join(rng.choice(["con", "ver", "sa", "tion", "al", "in", "ter", "na", "ment", "re"], 6))
    rows = [(i, f"use token = {key()} or {word()} and {word().title()} today") for i in range(400)]
    rows += [(1000 + i, f"use {key()} today") for i in range(40)] + [(2000 + i, f"use {word()} today") for i in range(40)]
    text = rows[0][1]
    hit = secret_scan.overlaps(secret_scan.base_spans(text))
    assert 1.0 in [secret_scan.label_of(text, *c, hit) for c in secret_scan.candidates(text)]
    found = {r.doc_id: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[1000 + i].n_candidates == 1 for i in range(40))
    assert sum(found[1000 + i].n_net for i in range(40)) >= 36 and sum(found[2000 + i].n_net for i in range(40)) <= 4


def test_weighted_threshold_and_overlaps():
    rng = np.random.default_rng(4)
    y = (rng.random(500) < 0.1).astype(float)
    margins, weight = np.round(rng.normal(4 * y - 2, 2), 1), rng.integers(1, 9, 500)
    assert np.isclose(secret_scan.calibrate(margins, y, 0.9, weight), secret_scan.calibrate(np.repeat(margins, weight), np.repeat(y, weight), 0.9))
    spans = sorted((int(a), 0, int(a + n)) for a, n in zip(rng.integers(0, 300, 20), rng.integers(1, 40, 20)))
    hit = secret_scan.overlaps(spans)
    for start in range(300):
        assert hit(start, start + 5) == any(s < start + 5 and start < e for s, _, e in spans)


def test_licenses(documents, texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in license_scan.licenses(documents).collect():
        words = word.findall(texts[r.doc_id].translate(lower))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            want = phrase.split()
            for i in range(len(words) - len(want) + 1):
                if words[i:i + len(want)] == want:
                    places.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_automaton_gives_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(60):
        notices = [rng.integers(0, 4, rng.integers(1, 12)).tolist() for _ in range(3)]
        text = rng.integers(0, 5, 30).tolist()
        parts = defaultdict(set)
        for k, n in enumerate(notices):
            for a in range(len(n)):
                for b in range(a + 1, len(n) + 1):
                    parts[tuple(n[a:b])].add((k, b))
        size = [max(m for m in range(e + 1) if not m or tuple(text[e - m:e]) in parts) for e in range(31)]
        want = [(e - size[e], size[e]) for e in range(1, 31) if size[e] and (e == 30 or size[e + 1] <= size[e])]
        automaton = license_scan.Automaton(notices)
        got = automaton.matches(text, 1)
        assert [(a, n) for a, n, _ in got] == want
        for a, n, state in got:
            assert set(automaton.ends[state]) == parts[tuple(text[a:a + n])]


def test_edited_notice_is_chained():
    scanner = license_scan.Scanner()
    text = license_scan.NOTICES["isc"][0].replace("any purpose", "any honest purpose").replace("appear in all", "are in all")
    found = scanner.spans(scanner.known(license_scan.words("Before. " + text + " After it.")))
    assert [s[2] for s in found] == ["isc"] and found[0][3] < 1


def components_of(sets, num, den):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, size, percent):
    rng = np.random.default_rng(size)
    docs = dict(list(texts.items())[:60])
    base = [f"q{i}" for i in range(90)]
    for i in range(50):  # a group of copies with none to many edits, in chains and alone
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 8)):
            words[at] = f"e{i}x{at}" if i % 2 else f"e{at}"
        docs[10_000 + i] = " ".join(words)
    docs.update({20_000: "two words", 20_001: "Two WORDS", 20_002: "", 20_003: None, 20_004: "one"})
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    want = components_of(sets, percent, 100)
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = near_dup.near_duplicates(frame, shingle=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), want[d], want[d] == d) for d in docs}


def test_least_matches_keeps_nearly_every_pair():
    rng = np.random.default_rng(0)
    for similarity in (0.8, 0.85):
        limit = near_dup.least_matches(32, similarity)
        assert (rng.binomial(32, similarity, 2_000_000) < limit).mean() < 2e-6


def test_signatures_estimate_similarity():
    rng, functions = np.random.default_rng(0), shingles.coordinates(256)
    for _ in range(10):
        a = np.unique(rng.integers(0, 2**63, 800).astype(np.uint64))
        b = np.unique(np.concatenate([a[:600], rng.integers(0, 2**63, 200).astype(np.uint64)]))
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((shingles.signature(a, functions) == shingles.signature(b, functions)).mean() - real) < 0.15


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 1000, 20_000):
        digests = rng.integers(0, 256, (n, 32)).astype(np.uint8)
        slots = exact_dedup._slot(exact_dedup._words(digests), exact_dedup.perfect_hash(digests), n)
        assert sorted(slots.tolist()) == list(range(n))
    packed = exact_dedup.pack_shard(digests, np.arange(n), np.zeros(n, bool), np.full(n, 2))
    member, keep, _, _ = exact_dedup.look_up(packed, digests)
    assert member.all() and (keep == np.arange(n)).all()
    other = digests.copy()
    other[:, 31] ^= 1  # differs in one bit of a byte that the hash never reads
    assert not exact_dedup.look_up(packed, other)[0].any()


def test_history_removes_repeats_and_groups_the_rest(spark):
    old = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id bigint, text string")
    new = spark.createDataFrame([(10, "a  b"), (11, "new"), (12, "n e w"), (13, "c")], "doc_id bigint, text string")
    history = exact_dedup.groups(exact_dedup.fingerprints(old))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(new, history).collect()}
    assert got == {10: (1, 2, False), 11: (12, 2, False), 12: (12, 2, True), 13: (3, 1, False)}
