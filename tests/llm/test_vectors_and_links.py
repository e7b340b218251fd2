"""Clusters, vector codes and URL filters against plain versions, and on odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticegrid.llm import centroids, link_trust, vector_codes
from noticegrid.llm.leading import leading, looked_up

VECTORS = "vec_id bigint, embedding array<float>, label int, v array<int>, code string, cluster int, distance string"
PAGES = "page_id bigint, url string, html string, host string, path string, ruled string, trust string, _salt int"


@pytest.fixture(scope="module")
def embeddings(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(64)], None if i % 3 == 0 else i % 2) for i in range(40)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], None), (None, rows[7][1], 0), (None, rows[7][1], 0)]  # repeated and missing ids
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 63 + [None], 1), (103, [float("nan")] * 64, 1), (104, [0.0] * 63 + [float("-inf")], 1)]
    rows += [(105, [0.0] * 63, 1), (106, [1e30] * 64, 1), (107, [-3e38] * 64, None)]
    return spark.createDataFrame([(*r, None, "v", 7, None) for r in rows], VECTORS).repartition(3, "vec_id")


def integers(rows, scale, reach, length=64):
    out = []
    for r in rows:
        x = r.embedding
        if x is None or len(x) != length or any(v is None or not np.isfinite(v) for v in x):
            continue
        out.append((r.vec_id, r.label, [int(np.floor(max(-reach, min(reach, float(np.float32(v)) * scale)))) for v in x]))
    return out


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_lloyd(items, books, rounds):
    """Codes, distances and entries by scanning every entry in every round."""
    for step in range(rounds + 1):
        near = [min((squared(v, c), k) for k, c in enumerate(books)) for v in items]
        if step == rounds:
            return near, books
        for k in range(len(books)):
            own = [v for v, (_, code) in zip(items, near) if code == k]
            if own:
                books[k] = [sum(column) // len(own) for column in zip(*own)]


def plain_clusters(rows, count=16):
    kept = integers(rows, 64, centroids.REACH)
    named = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    first = [list(v) for _, v in sorted((named(i), v) for i, _, v in kept)[:count]]
    near, books = plain_lloyd([v for _, _, v in kept], first, 3)
    inertia = [sum(d for d, k in near if k == c) for c in range(count)]
    long = lambda n: n if n < 2**63 else None
    digests = [hashlib.sha256(",".join(map(str, b)).encode()).hexdigest() for b in books]
    return sorted((str(i), k, d, str(long(inertia[k])), str(long(sum(inertia))), digests[k]) for (i, _, _), (d, k) in zip(kept, near))


def test_clusters_against_plain_rounds(embeddings, odd_vectors):
    for table in (embeddings, odd_vectors):
        got = [(str(r.vec_id), r.cluster, r.distance, str(r.cluster_inertia), str(r.inertia), r.centroid_sha256) for r in centroids.clusters(table).collect()]
        assert sorted(got) == plain_clusters(table.collect())


def test_clusters_of_few_and_no_vectors(spark, odd_vectors):
    assert centroids.clusters(odd_vectors.limit(0)).count() == 0
    assert centroids.clusters(odd_vectors.filter("vec_id >= 100 and vec_id <= 105")).count() == 0
    three = odd_vectors.filter("vec_id in (1, 2, 4)")
    assert [(r.distance, r.inertia) for r in centroids.clusters(three).collect()] == [(0, 0)] * 3


def plain_codes(rows, entries=256):
    lengths = sorted((r.vec_id is None, r.vec_id or 0, len(r.embedding)) for r in rows if r.embedding and integers([r], 1, 1, len(r.embedding)))
    kept = integers(rows, 1024, vector_codes.REACH, lengths[0][2])
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 4
    codes, errors, final = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        items = [v[p * width:(p + 1) * width] for _, _, v in kept]
        near, books = plain_lloyd(items, [list(x) for x in items[:entries]], 4)
        final += [str(x) for b in books for x in b]
        for i, (d, k) in enumerate(near):
            codes[i] += f"{k:02x}"
            errors[i] += d
    of_label = {}
    for (_, label, _), e in zip(kept, errors):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(final).encode()).hexdigest()
    return sorted((str(i), c, e, of_label[label], digest) for (i, label, _), c, e in zip(kept, codes, errors))


def test_codes_against_plain_rounds(odd_vectors):
    for entries in (256, 9):  # all vectors are entries; many vectors share one
        got = vector_codes.compressed(odd_vectors, entries=entries).collect()
        assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(odd_vectors.collect(), entries)
    assert vector_codes.compressed(odd_vectors.limit(0)).count() == 0
    assert vector_codes.compressed(odd_vectors.filter("vec_id = 105")).count() == 0  # 63 components are not four equal parts


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(3)
    for trial in range(200):
        x = rng.integers(-3, 4, (60, 3)) * (1 if trial % 2 else 1 << 26)
        old = rng.integers(-3, 4, (12, 3)) * (1 if trial % 2 else 1 << 26)
        new = old.copy()
        at = rng.random(12) < rng.random()
        new[at] += rng.integers(-1, 2, (at.sum(), 3))
        code, near = vector_codes.scanned(x, old)
        code, near = vector_codes.reassigned(x, code, near, old, new)
        want = [min((int(((v - e) ** 2).sum()), k) for k, e in enumerate(new)) for v in x]
        assert list(zip(near.tolist(), code.tolist())) == want


def test_leading_rows(spark):
    rows = spark.range(50_000).select(F.pmod(F.col("id") * 7919, F.lit(20_011)).alias("k"), "id").repartition(7).cache()
    for count in (1, 30, 5_000):
        got = [(r.k, r.id) for r in leading(rows, F.col("k"), count, ["k", "id"]).collect()]
        assert got == sorted((r.k, r.id) for r in rows.collect())[:count]
    same = rows.withColumn("k", F.lit(1).cast("bigint"))
    assert [r.id for r in leading(same, F.col("k"), 3, ["k", "id"]).collect()] == [0, 1, 2]
    assert looked_up(rows, rows.select("id", F.lit(1).alias("one")).filter("id < 10"), "id").filter("one = 1").count() == 10


@pytest.fixture(scope="module")
def linked_pages(spark):
    rng = random.Random(11)
    hosts = [f"h{i}.example.{t}" for i in range(14) for t in ("com", "net", "org")]
    rows = []
    for i in range(400):
        links = "".join(
            f"<a class=x href={q}{rng.choice(['http:', 'HTTPS:', ''])}//{rng.choice(hosts).upper()}/p{q}>t</a><a href='/own'>o</a>"
            for q in rng.choices(['"', "'"], k=rng.randrange(4))
        )
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}?q=/en/#x", f"<html>{links}</html>", *[None] * 5))
    rows += [
        (400, None, "<a href='http://h1.example.net/'>", *["x"] * 4, 1), (401, "no scheme /en/", None, *[None] * 5), (402, "HTTP://EXAMPLE.com/en/", "", *[None] * 5),
        (403, "http://www.Example.COM/en/x", "", *[None] * 5), (404, "http://com", "", *[None] * 5), (405, "http://xcom/", "", *[None] * 5),
        (406, "a://b\nc://d.net/es/\nmore?x://y", "<a\nhref = //H2.example.org:80>", *[None] * 5), (406, "http://d.net/es", None, *[None] * 5), (None, "http://É.net/fr/É", None, *[None] * 5),
    ]
    return spark.createDataFrame(rows, PAGES).repartition(5)


def plain_cut(url):
    url = url or ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def plain_rule(host, path):
    best = None
    for verdict, h, p in link_trust.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), verdict == "block", h + p, verdict))
    return (best[3], best[4]) if best else (None, None)


def plain_verdicts(rows):
    import re

    cut = [(r, *plain_cut(r.url)) for r in rows]
    decided = [(r, h, p, *plain_rule(h, p)) for r, h, p in cut]
    pairs = {}
    for r, h, _, _, _ in decided:
        for found in re.findall(r"""<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>\\]+)""", r.html or "", re.I):
            if h and found.lower() != h:
                pairs[h, found.lower()] = pairs.get((h, found.lower()), 0) + 1
    names = sorted({h for _, h, _, _, _ in decided if h} | {x for pair in pairs for x in pair})
    at = {h: i for i, h in enumerate(names)}
    seeds = {v: np.zeros(len(names)) for v in ("allow", "block", None)}
    for _, h, _, _, verdict in decided:
        if h:
            seeds[verdict][at[h]] += 1
    links = np.zeros((len(names), len(names)))
    for (a, b), n in pairs.items():
        links[at[a], at[b]] = n
    scores = []
    for weights, seed in ((links, seeds["allow"]), (links.T, seeds["block"])):
        total = weights.sum(1, keepdims=True)
        walk = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
        mass = seed.copy()
        for _ in range(500):
            mass = 0.85 * (mass @ walk + mass[total[:, 0] == 0].sum() * seed / max(1, seed.sum())) + 0.15 * seed
        scores.append(mass)
    trust, distrust = scores
    shut = {h for h in names if distrust[at[h]] > 0.500001 * (distrust[at[h]] + trust[at[h]] + seeds[None][at[h]])}
    verdicts = sorted((str(r.page_id), h, p, str(rule), v or ("block" if h in shut else "allow")) for r, h, p, rule, v in decided)
    return verdicts, dict(zip(names, zip(trust, distrust))), shut


def test_url_filter_against_a_dense_walk(linked_pages):
    want, scores, shut = plain_verdicts(linked_pages.collect())
    got = link_trust.judged(linked_pages, rounds=200, tolerance=1e-12).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    found = link_trust.host_scores(linked_pages, rounds=200, tolerance=1e-12).collect()
    assert {r.host for r in found} == set(scores) and {r.host for r in found if r.shut} == shut and shut
    for r in found:
        assert (r.trust, r.distrust) == pytest.approx(scores[r.host], abs=1e-6)
    # Undecided pages fall on both sides, and distrust alone shuts hosts that have no page of their own decided.
    assert {v for _, _, _, rule, v in want if rule == "None"} == {"allow", "block"}


def test_url_filter_of_no_pages_and_no_rules(spark, linked_pages):
    assert link_trust.judged(linked_pages.limit(0)).count() == 0
    assert {(r.rule, r.verdict) for r in link_trust.judged(linked_pages, []).collect()} == {(None, "allow")}
    by_id = {r.page_id: r for r in link_trust.judged(linked_pages.filter("page_id >= 400")).collect()}
    assert (by_id[400].host, by_id[400].path, by_id[400].verdict) == ("", "", "allow")
    assert [by_id[i].rule for i in (402, 403, 404, 405)] == ["example.com/en/", "www.example.com/en/", None, None]
