import numpy as np

from millrace.llm import packing as pk


def test_every_token_once_and_no_bin_overfull(spark):
    rows = [(i, "w " * n) for i, n in enumerate([0, 1, 5, 300, 4095, 4096, 9000, 120, 700] * 5)] + [(None, None), (3, ""), (3, ""), (50, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as piece").repartition(3)
    got = pk.packed(docs).collect()
    assert sum(r.n_tokens for r in got) == sum(1 + len((t or "").split()) for _, t in rows)
    bins = {}
    for r in got:
        assert r.bin_length in pk.LENGTHS
        bins.setdefault(r.bin, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == [0, *np.cumsum([r.n_tokens for r in own])[:-1]]
        used = sum(r.n_tokens for r in own)
        assert own[0].bin_length == min(c for c in pk.LENGTHS if c >= used)
    assert pk.packed(docs.limit(0)).collect() == []


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 4097, 300))[::-1]
    left, bins, out = int(sizes.sum()), [], []
    for s in map(int, sizes):
        fit = [(free, i) for i, (free, _) in enumerate(bins) if free >= s]
        if fit:
            _, i = min(fit)
        else:
            c = min((c for c in pk.LENGTHS if c >= s), key=lambda c: (pk.cost(c) / min(c, left), -c))
            bins.append((c, 0))
            i = len(bins) - 1
        bins[i] = (bins[i][0] - s, bins[i][1] + s)
        out.append(i)
        left -= s
    got, _, length = pk.pack(sizes)
    assert got.tolist() == out
    fill = sizes.sum() / sum(min(c for c in pk.LENGTHS if c >= used) for _, used in bins)
    assert fill > 0.9


def test_lengths_to_open_are_jointly_best():
    rng = np.random.default_rng(2)
    for make in (lambda: rng.integers(1, 4097, 2000), lambda: np.minimum(4096, rng.geometric(1 / 300, 2000)), lambda: rng.choice([130, 390, 700, 1500], 2000)):
        sizes, n = np.unique(make(), return_counts=True)
        counts = dict(zip(sizes.tolist(), n.tolist()))
        best = pk.packing_cost(pk.scaled(counts), pk.LENGTHS, pk.best_opening(counts))
        assert best <= pk.packing_cost(pk.scaled(counts), pk.LENGTHS, None)
        for one in pk.LENGTHS:
            assert best <= pk.packing_cost(pk.scaled(counts), pk.LENGTHS, {c: max(c, one) for c in pk.LENGTHS})
    assert len(pk.scaled({5: 10**9, 7: 1, 9: 10**9}, 100)) == 100


def test_ids_of_all_documents_are_packed(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, "the story of " * n) for i, n in enumerate([0, 1, 40, 1500, 7, 90])] + [(None, None), (3, ""), (2, "Été, 3!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = pk.packed(docs, tokenizer_path=path).collect()
    whole = {}
    for r in sorted((r for r in got if r.doc_id in (0, 1, 4, 5)), key=lambda r: r.piece):
        assert len(r.ids) == r.n_tokens and r.place + r.n_tokens <= r.bin_length
        whole[r.doc_id] = whole.get(r.doc_id, []) + r.ids
    assert whole == {d: plain.encode(t, add_special_tokens=False).ids + [2] for d, t in rows if d in whole}
    assert sum(r.n_tokens for r in got) == sum(1 + len(plain.encode(t or "").ids) for _, t in rows)


def test_words_are_the_text_of_a_piece(spark):
    text = " ".join(str(i) for i in range(9000))
    got = sorted(pk.packed(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r.piece)
    assert [r.n_tokens for r in got] == [4096, 4096, 809] and " ".join(r.text for r in got) == text
