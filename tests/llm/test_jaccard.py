import random
import re

import numpy as np

from vectide.llm.components import components
from vectide.llm.jaccard import boundary, similar_components


def brute(docs, percent=75, width=5):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())
        sets.append({tuple(w[p : p + width]) for p in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    big = 1 << 62
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), big), big if d is None else d)
    return sorted((str(d), len(sets[i]), str(None if least[root(i)] == big else least[root(i)])) for i, (d, _) in enumerate(docs))


def documents(seed, size):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d"), (8, "x " * 40), (9, "x " * 50), (None, "lonely text"), (None, "a b c d")]
    for i in range(10, 60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(5, size))]
        if rnd.random() < 0.4:
            base = passage + base
        for k in range(rnd.randint(1, 5)):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(copy) // 25)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            docs.append((100 * i + k, rnd.choice([" ", "\n", "  "]).join(copy)))
    return docs + [docs[-1], (100 * i, docs[20][1])]


def test_against_brute_force(spark):
    for seed, size, n in ((1, 120, 3), (2, 14, 2), (3, 40, 4)):
        docs = documents(seed, size)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_components(df, n=n).collect())
        assert got == brute(docs)


def test_hub_that_links_with_few(spark):
    """Chains: each text shares enough with the next only, so members that don't link with the hub must find each other."""
    words = [f"v{k}" for k in range(400)]
    docs = [(k, " ".join(words[6 * k : 6 * k + 80])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_components(df, n=3).collect())
    assert got == brute(docs) and {c for *_, c in got} == {"0"}


def test_boundary_and_empty(spark):
    assert boundary({}, 75) == 0 and boundary({3: 100, 200: 5}, 75) >= 3
    assert boundary({20: 1000}, 75) < 20
    df = spark.createDataFrame([], "doc_id long, text string, node int")
    assert similar_components(df).collect() == []


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(up)}


def test_forest_connects_the_same_nodes():
    from vectide.llm.components import forest

    rnd = np.random.default_rng(3)
    for size in (0, 1, 5, 40, 200):
        a, b = rnd.integers(0, 100, size).astype("u8"), rnd.integers(0, 100, size).astype("u8")

        def roots(pairs):
            least = {int(x): int(x) for x in np.concatenate([a, b])}
            for _ in range(len(least)):
                for x, y in pairs:
                    least[x] = least[y] = min(least[x], least[y])
            return least

        stars = list(zip(*(x.tolist() for x in forest(a, b))))
        assert roots(stars) == roots(list(zip(a.tolist(), b.tolist())))
        assert len(stars) < max(1, len(set(a.tolist()) | set(b.tolist())))


def local(docs, n=3, r=2, percent=75, width=5):
    """The stages of similar_components without Spark, so that hashes can be changed."""
    import pyarrow as pa

    from vectide.llm import exchange as X
    from vectide.llm import jaccard as J

    table = pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "h": pa.array([hash(t) for _, t in docs], pa.int64()), "chunk": pa.array([k % n for k in range(len(docs))], pa.int32())})
    packs = pa.Table.from_batches(list(X._pack(table.to_batches())))
    texts = {c: packs.filter(pa.array([x == c for x in packs["chunk"].to_pylist()], pa.bool_())) for c in range(n)}

    def dealt(tables):
        t = pa.concat_tables([X.rows([]), *tables])
        return {d: t.filter(pa.array([x == d for x in t["dest"].to_pylist()], pa.bool_())) for d in set(t["dest"].to_pylist())}

    def of(tables, kinds):
        return [t.filter(pa.array([x in kinds for x in t["kind"].to_pylist()], pa.bool_())) for t in tables]

    light = J.boundary({}, percent) or 4
    state = dealt([J._representatives(t) for t in dealt([J._digests(t, r, width) for t in texts.values()]).values()])
    levels = [J._frequencies(t) for t in dealt([J._shingles(texts[c], state[c], r, width, light, percent) for c in texts]).values()]
    levels = dealt([*levels, *state.values()])
    posts = [J._post(texts[c], levels[c], r, width, light, percent) for c in texts]

    def tested(probes):
        sets = [J._ship(texts[c], t) for c, t in dealt(probes).items()]
        return [J._test(texts[c], t, r, width, percent) for c, t in dealt([*sets, *of(posts, [J.POSTINGS])]).items()]

    first = tested([J._hubs(t) for t in dealt(of(posts, [J.HUBS])).values()])
    second = tested([J._rest(t) for t in dealt([*of(first, [J.UNLINKED]), *of(posts, [J.HUBS])]).values()])
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for batch in J._edges(b for t in of([*first, *second], [J.EDGES]) for b in t.to_batches()):
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    members = pa.concat_tables([J._members(pa.concat_tables(of([t], [J.DOCS, J.REPS])), r) for t in levels.values()]).to_pylist()
    least = {}
    for m in members:
        x = root(m["node"])
        least[x] = min(least.get(x, 1 << 62), 1 << 62 if m["rep_id"] is None else m["rep_id"])
    return sorted((str(m["doc_id"]), m["n_shingles"], str(None if least[root(m["node"])] == 1 << 62 else least[root(m["node"])])) for m in members)


def test_short_texts_of_one_hash(spark):
    """Two words whose hashes share 48 bits."""
    docs = [(1, "aaacxisv"), (2, "aacfxsay"), (3, "aaacxisv")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in similar_components(df).collect()) == [(1, 1), (2, 2), (3, 1)]
    assert local(docs) == brute(docs)


def test_colliding_shingles(monkeypatch):
    """Where all shingles have one of a few hashes, or all the same, words decide: sizes and links stay right."""
    from vectide.llm import textnp

    docs = documents(4, 30) + [(7000 + k, f"t{k} a b c d e") for k in range(6)] + [(8000 + k, "one two three four five " * 2 + f"z{k % 3}") for k in range(6)]
    want = brute(docs)
    assert local(docs) == want
    windows, run_hash = textnp.Words.windows, textnp.Words.run_hash
    for few in (50, 1):
        small = lambda h: (h % np.uint64(few)) << np.uint64(16)  # noqa: B023, E731
        monkeypatch.setattr(textnp.Words, "windows", lambda self, k: (lambda at, h: (at, small(h)))(*windows(self, k)))  # noqa: B023
        monkeypatch.setattr(textnp.Words, "run_hash", lambda self, a, b: small(run_hash(self, a, b)))  # noqa: B023
        assert local(docs) == want


def test_same_set_in_another_order(spark):
    """Texts of one set of shingles but other words are nodes of their own, and link."""
    docs = [(1, "x " * 40), (2, "x " * 50), (3, "a b c d e f a b c d e f"), (4, "b c d e f a b c d e f a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_components(df).collect()) == brute(docs)


def test_far_copies_do_not_travel_again(monkeypatch):
    """Copies of one text that are too far from each other share lists; a text travels a second time only to texts that it links with."""
    from vectide.llm import exchange as X
    from vectide.llm import jaccard as J

    rnd = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    docs = [(k, " ".join(w if rnd.random() > (0.04 if k % 4 else 0.01) else f"e{rnd.random()}" for w in base)) for k in range(80)]
    rest, shipped = J._rest, []

    def counted(t):
        out = rest(t)
        for home, _, p in X.by_kind(out, J.SHIPS):
            shipped.extend((3 * int(idx) + home, int(to)) for idx, to in zip(*X.load(p, ["u4", "u4"])))
        return out

    monkeypatch.setattr(J, "_rest", counted)
    want = brute(docs)
    assert local(docs) == want and len({c for *_, c in want}) > 20
    words = [t.split() for _, t in docs]
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in words]
    links = lambda a, b: a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert shipped and all(any(links(u, d) for d in range(to, len(docs), 3)) for u, to in shipped)


def test_pairs_of_a_hub_by_brute_force():
    """Where 16 bits tell all hashes apart, exactly the pairs that link; where they don't, these and others."""
    from vectide.llm import jaccard as J

    rnd = np.random.default_rng(2)
    for size, few in ((2, 1 << 16), (12, 1 << 16), (60, 1 << 16), (60, 7)):
        hub, base = np.arange(90), np.arange(60, 150)
        sets = [{*rnd.permutation(base if k % 3 else hub)[: rnd.integers(70, 91)].tolist(), *rnd.integers(200, 400, rnd.integers(0, 12)).tolist()} for k in range(size)]
        linked = [100 * len(s & {*hub.tolist()}) >= 75 * len(s | {*hub.tolist()}) for s in sets]
        flags = np.array([int(x) | (2 if k == size - 1 else 0) for k, x in enumerate(linked)], "u1")
        bits = [np.packbits(np.isin(hub, list(s))) for s in sets]
        outs = [np.array([x % few for x in s if x not in hub], "u2") for s in sets]
        ragged = [(np.concatenate(x), np.cumsum([0] + [len(y) for y in x])) for x in (bits, outs)]
        got = {(min(u, m), max(u, m)) for us, ms in J._close(np.array([len(s) for s in sets]), flags, *ragged, 75) for u, m in zip(us.tolist(), ms.tolist())}
        want = {(i, j) for j in range(size) for i in range(j) if not (linked[i] and linked[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
        assert want <= got
        if few > 400:
            assert {p for p in got if size - 1 not in p} == {p for p in want if size - 1 not in p}
