"""The training-text operators against brute force on small fixtures, with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import jaccard, lines, lm, mixing, pieces, pii, quality, sketch, tokens, wavelet
from lectern.llm.common import placed

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q string, size string, at int, _at int, _doc int, _place int, row string, place string"


def fixture(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "q", "x", 1, 2, 3, 4, "r", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{r.randrange(400)}" for _ in range(300)]
    texts = []
    for i in range(n):
        if i % 5 == 4:
            w = texts[-1].split(" ")
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = "Edit"
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 30))) + "." for _ in range(r.randrange(1, 5))))
    return [*texts, None, "", "   \n\t ", "a b", "A  b", texts[0], "long " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return fixture(spark, sample()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty):
    assert tokens.count_tokens(empty, BPE).count() == 0
    assert sketch.edited_fingerprints(empty).count() == 0
    assert jaccard.joined(empty).count() == 0
    assert quality.verdicts(empty).count() == quality.cleaned(empty).count() == 0
    assert lines.report(empty).count() == lines.cleaned(empty).count() == 0
    assert mixing.plan(empty).count() == mixing.mixed(empty).count() == 0
    assert pieces.encoded(empty, PIECE).count() == 0
    assert pii.personal_data(empty).count() == 0


def test_empty_tables_written(empty):
    assert wavelet.token_files(empty, BPE).count() == 0
    assert lm.scores(empty).count() == 0


def test_token_counts(docs):
    t = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.count_tokens(docs, BPE, 100).collect():
        text = texts[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)


def test_encoder_on_odd_white_space_and_special_strings():
    e, t = tokens.encoder(BPE), Tokenizer.from_file(BPE)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y z", "  a  b ", "a\n\nb", "a \nb", "tab\tbed c", "\x1cx y", "日本 語\nü", "a" * 300, "x y " * 40000 + " z"]
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_edited_fingerprints(docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in sketch.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for a, b in zip(rows, rows[1:] + rows[:1]):
        x, y = a.text or "", b.text or ""
        k = len(x) // 3
        edited = x[: len(x) - k] + y[:k]
        r = got[a.doc_id]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(x)
        assert r.fingerprint == sketch.text_of(sketch.sketch(x.encode(), sketch.WordHashes()))
        assert r.near_next == sketch.likeness(sketch.sketch_of(r.fingerprint), sketch.sketch_of(got[b.doc_id].fingerprint))
        assert 0 <= r.near_edited <= 1 and (edited != x or r.near_edited == 1)


def test_edited_fingerprints_do_not_need_a_shared_exchange(spark):
    r = random.Random(12)
    docs = fixture(spark, [f"t{i} " * r.randrange(9) for i in range(300)], ids=[None, None, 5, 5, *range(100, 396)]).repartition(5)
    plain = sorted(sketch.edited_fingerprints(docs).drop("fingerprint").collect(), key=repr)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert sorted(sketch.edited_fingerprints(docs).drop("fingerprint").collect(), key=repr) == plain
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert collections.Counter(x.doc_id for x in plain) == collections.Counter([None, None, 5, 5, *range(100, 396)])


def test_sketches_merge():
    h = sketch.WordHashes()
    a, b = " ".join(map(str, range(500))), " ".join(map(str, range(400, 900)))
    both = sketch.merge(sketch.sketch(a.encode(), h), sketch.sketch(b.encode(), h))
    assert set(both) <= set(sketch.sketch(a.encode(), h)) | set(sketch.sketch(b.encode(), h))
    assert sketch.containment(sketch.sketch(a.encode(), h), both) == 1


def components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, k, percent):
    want = components({r.doc_id: r.text for r in docs.collect()}, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs, k, percent).collect()} == want


def test_jaccard_of_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    want = components(dict(enumerate(texts)), 4, 85)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(fixture(spark, texts)).collect()} == want


def test_jaccard_of_copies_that_do_not_link_with_their_base(spark):
    """Families about the threshold: each copy changes, adds or loses words; some families have second bases; rows are dealt over tasks."""
    r = random.Random(11)
    texts = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(160)]
        bases = [base, base[:70] + [f"g{family}w{i}" for i in range(12)] + base[70:], base[15:]]
        for _ in range(70):
            w = list(bases[r.randrange(len(bases) if family % 2 else 1)])
            for _ in range(r.randrange(3, 13)):
                at = r.randrange(len(w))
                kind = r.randrange(4)
                w[at : at + (kind > 0)] = [] if kind == 1 else [f"x{r.randrange(40 if family == 3 else 10**6)}"]
            texts.append(" ".join(w))
    r.shuffle(texts)
    texts += texts[:40]
    want = components(dict(enumerate(texts)), 4, 85)
    assert 100 < len({c for _, c in want.values()}) < 320
    docs = fixture(spark, texts).repartition(7)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(docs).collect()} == want
    want = components(dict(enumerate(texts)), 3, 70)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(docs, 3, 70).collect()} == want


def test_representatives_of_null_and_repeated_ids(spark):
    r = random.Random(8)
    texts = [" ".join(f"v{r.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    a, b, c, d, e, f = texts[:6]
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (1, c), (1, c), (2, c), (1, d), (3, e), (4, e), (4, f), (None, None), (None, "")]
    got = collections.Counter((x.doc_id, x.text) for x in jaccard.representatives(fixture(spark, [t for _, t in rows], ids=[i for i, _ in rows]), 5, 80).collect())
    assert sum(got.values()) == 8 and got[None, a] + got[None, a + " more"] == 1
    assert all(got[x] == 1 for x in ((None, b), (1, c), (1, d), (3, e), (4, f), (None, None), (None, "")))


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_quality_rules(spark):
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8))
    texts = [good, good + "\nAll rights reserved.", "Home | About | News | Contact | Shop\n" * 30, "same words again " * 40, None, "", "short.", good.replace(" ", " | ")]
    got = {r.doc_id: r for r in quality.verdicts(fixture(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {j + d for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for d in range(3)}
        worded = [x for x in (t or "").split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(rep))
        assert r.n_dup_lines == len(worded) - len(set(worded)) and r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    kept = {r.doc_id: r for r in quality.cleaned(fixture(spark, texts)).collect()}
    assert set(kept) <= {i for i, r in got.items() if r.kept} and kept.keys() == {i for i, r in got.items() if r.kept}
    assert set(kept) == {0, 1}
    assert all("rights reserved" not in r.text and r.n_chars == len(r.text) and (r.q, r.row, r.place) == ("q", "r", "p") for r in kept.values())


def test_lines_that_are_no_prose_go(spark):
    prose = {
        "en": "The river rose in the night and it was over the bridge by the morning of the feast.",
        "de": "Der Fluss stieg in der Nacht und stand am Morgen des Festes über der alten Brücke.",
        "fr": "La rivière monta dans la nuit et passa le pont au matin de la fête avec le vent.",
        "es": "El río subió en la noche y pasó el puente por la mañana de la fiesta con el viento.",
        "fi": "Joki nousi yöllä ja peitti sillan aamulla kun juhla alkoi ja tuuli kääntyi pohjoiseen illaksi.",
    }
    bad = {
        "en": ["Home / News / Our shop / Help", "Home > Sport > Results", "Read the whole story of the flood…", "See our Privacy Policy.", "red blue green white black brown grey pink gold teal lime plum.", "### *** ### !!! %"],
        "de": ["Start · Über uns · Kontakt", "Mehr dazu ...", "ALLE RECHTE VORBEHALTEN.", "Zur Datenschutzerklärung."],
        "fr": ["Accueil › Nos vins › Blancs", "TOUS DROITS RÉSERVÉS.", "Lire la suite...", "Mentions légales."],
        "es": ["Inicio | Tienda | Ayuda", "Política de privacidad.", "Leer el resto…", "Síguenos en la red."],
        "fi": ["Etusivu :: Uutiset :: Kauppa"],
    }
    fine = ["Price / weight / height of all of the boxes that we sold in the last year / month.", "Yes.", "He paused and then he said to the man at the door that it was far too late for him to go on…", ""]
    texts, wanted = [], []
    for lang, line in prose.items():
        kept = [line] + [f"{line} {lang} {i}." for i in range(6)] + (fine if lang == "en" else [])
        mixed = [kept[0], *(x for pair in zip(kept[1:], bad[lang] + [" Yes. "] * 20) for x in pair if x != " Yes. ")]
        texts.append("\n".join(mixed))
        wanted.append("\n".join(kept))
    texts += ["\n".join([prose["en"] + f" {i}." for i in range(9)] + ["Short one.", " Short one.\r", prose["en"] * 2, prose["en"] * 2, "Short one."])]
    wanted += ["\n".join([prose["en"] + f" {i}." for i in range(9)] + ["Short one.", prose["en"] * 2, prose["en"] * 2])]
    texts += ["\n".join([prose["en"]] * 8 + ["Home | News | Shop | Help | Home pages | All sites"] * 20), "\n".join(f"{prose['de']} {i}" for i in range(5)) + "\n" * 3]
    wanted += ["\n".join([prose["en"]] * 8), texts[-1]]
    got = {r.doc_id: r.cleaned for r in quality.measured(fixture(spark, texts)).select("row.doc_id", "q.cleaned").collect()}
    assert [got.get(i) for i in range(len(texts))] == wanted


def test_line_dedup_keeps_the_first_occurrence(spark):
    texts = [f"own line {i}.\n shared \r\nrare" if i < 3 else f"own line {i}.\nshared" for i in range(8)] + [None, "", "shared"]
    got = {r.row.doc_id: r for r in lines.deduplicated(fixture(spark, texts, [f"s{i % 6}" if i % 6 else None for i in range(len(texts))])).collect()}
    assert got[0].cleaned == texts[0] and got[1].cleaned == "own line 1.\nrare" and got[5].dropped == [1] and got[8].cleaned is None and got[10].cleaned == "" and got[3].row.q == "q"
    assert {r.doc_id for r in lines.cleaned(fixture(spark, texts, [f"s{i % 6}" for i in range(len(texts))])).collect()} == {0, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert all(not r.dropped for r in lines.deduplicated(fixture(spark, texts, ["one"] * len(texts))).collect())


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 50257, 5000).astype("<u2")
    ids[::7] = 11
    w = wavelet.WaveletMatrix.of(ids, 16)
    again = wavelet.WaveletMatrix.read(w.n, 16, w.zeros, *w.blobs())
    assert (again.decode() == ids).all() and [again.access(i) for i in (0, 63, 64, 4999)] == ids[[0, 63, 64, 4999]].tolist()
    places = np.flatnonzero(ids == 11)
    assert again.count(11) == len(places) and [again.select(11, k) for k in (0, 100, len(places) - 1)] == places[[0, 100, -1]].tolist()
    assert again.rank(11, 1234) == (ids[:1234] == 11).sum()
    with pytest.raises(IndexError):
        again.select(11, len(places))


def test_token_files(docs):
    t = Tokenizer.from_file(BPE)
    start = 0
    got = {r.doc_id: r for r in wavelet.token_files(docs, BPE, 2).collect()}
    for d in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_mixture(spark):
    r = random.Random(2)
    texts = [" ".join(["w"] * r.randrange(1, 60)) for _ in range(400)] + [None, ""]
    sources = [("a", "b", "c", None)[0 if i % 3 else i % 4] for i in range(len(texts))]
    rows = mixing.mixture(placed(fixture(spark, texts, sources))).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, total = dict(zip(order, (5, 2, 1, 5))), sum(sizes.values())
    target, free = {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    taken = collections.Counter()
    for x in rows:
        assert x.target == pytest.approx(target[x.source]) and x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    mixed = mixing.mixed(fixture(spark, texts, sources)).collect()
    assert collections.Counter(x.doc_id for x in mixed) == {x.doc_id: x.copies for x in rows if x.copies}


def test_mix_of_null_and_repeated_ids(spark):
    texts = [f"w{i} " * (i + 1) for i in range(12)]
    docs = fixture(spark, texts, ids=[None] * 4 + [1] * 4 + [1, 2, 2, 3])
    copies = sum(x.copies for x in mixing.mixture(placed(docs)).collect())
    got = collections.Counter(x.text for x in mixing.mixed(docs).collect())
    assert sum(got.values()) == copies and max(got.values()) <= mixing.MAX_EPOCHS


def test_mix_keeps_rows_of_one_id_apart_and_its_order(spark, tmp_path):
    texts = [f"w{i} " * 9 for i in range(30)]
    docs = fixture(spark, [*texts, texts[0]], [f"s{i % 2}" for i in range(31)], ids=[*range(30), 0])
    m = mixing.mixture(placed(docs)).collect()
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {(x._at, x._doc, x.row, x.place) for x in mixed.collect()} == {(2, 3, "r", "p")}
    assert collections.Counter(x.doc_id for x in mixed.collect()) == collections.Counter([x.doc_id for x in m for _ in range(x.copies)])
    mixed.write.parquet(str(tmp_path / "m"))
    again = placed(spark.read.parquet(str(tmp_path / "m"))).orderBy("place").select("row.doc_id").collect()
    assert [x.doc_id for x in again] == [x.doc_id for x in mixed.collect()]


def test_lines_of_rows_that_share_an_id(spark):
    texts = [f"shared\nown {i}." for i in range(6)] + ["other 6.\nmore 6."]
    docs = fixture(spark, texts, [f"s{i}" for i in range(7)], ids=[0, 1, 2, 3, 4, 5, 5])
    got = sorted((x.doc_id, x.text, x._doc) for x in lines.cleaned(docs).collect())
    assert got == [(0, "shared\nown 0.", 3), *((i, f"own {i}.", 3) for i in range(1, 5)), (5, "other 6.\nmore 6.", 3), (5, "own 5.", 3)]


def test_demand_time_inverts_the_integral(spark):
    t = spark.range(101).select((F.col("id") / 100).alias("t"))
    for lean in (-0.5, 0.0, 0.5):
        share = F.col("t") + lean * (F.col("t") * F.col("t") - F.col("t"))
        assert t.where(F.abs(mixing.demand_time(share, F.lit(lean)) - F.col("t")) > 1e-9).count() == 0


def test_pieces_equal_the_library_without_dropout_and_decode_with_it():
    import sentencepiece

    texts = [t for t in sample() if t] + ["  two  spaces", "é😀\nx", "x" * 200, " "]
    m, sp = pieces.Pieces(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    plain, varied = pieces.Segmenter(m, 0, 0), pieces.Segmenter(m, 0.3, 1)
    assert [plain.encode(t, 1) for t in texts] == sp.encode(texts)
    found = [varied.encode(t, i) for i, t in enumerate(texts)]
    assert [m.decode(x) for x in found] == texts and found != [plain.encode(t, 1) for t in texts]
    assert found == [pieces.Segmenter(m, 0.3, 1).encode(t, i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [0, 1 << 28, 1 << 31, (1 << 32) - 1])
def test_words_segmented_together_equal_words_alone(limit):
    m, rng = pieces.Pieces(PIECE), random.Random(limit)
    for width in (1, 2, 3, 7, 24):
        words = ["".join(rng.choice("▁▁aeinrstß日𝄞\x00") for _ in range(width)) for _ in range(200)] + ["▁international"[:width].ljust(width, "s")]
        keys = [rng.getrandbits(64) for _ in words]
        ids, counts, merges = m.segment_all(words, np.array(keys, np.uint64), limit)
        together = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert len(together) == len(words) and (merges <= width - 1).all()
        assert together == [m.segment(w, k, limit) for w, k in zip(words, keys)]


def test_encoded_rows_are_lossless(docs):
    out = pieces.encoded(docs, PIECE)
    assert out.where("NOT lossless").count() == 0
    back = {r.doc_id: r.text for r in pieces.decoded(out, PIECE).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


def test_each_occurrence_of_a_word_is_varied_on_its_own():
    m = pieces.Pieces(PIECE)
    s, n = pieces.Segmenter(m, 0.1, 0), 4000
    for word in ("the", "international", "é😀schichten", "x" * 70):
        text = " ".join([word] * n)
        ids = s.encode(text, 1)
        starts = [0, *np.cumsum([len(x.encode()) + 1 for x in [word] * n]).tolist()]
        ends = np.cumsum([len(m.surface[i]) for i in ids])
        cuts = np.searchsorted(ends, starts[1:]) + 1
        ways = collections.Counter(tuple(ids[a:b]) for a, b in zip([0, *cuts], cuts))
        plain = m.segment(pieces.SPACE + word)
        merges = len(m._long(pieces.SPACE + word, 0, 0)) if len(word) > 47 else len(m._short(pieces.SPACE + word, 0, 0))
        merges = len(word) + 1 - merges
        assert m.decode(ids) == text and len(ways) > 2
        # Other skips may end in the same pieces, so that this is the least share of the plain ones.
        assert ways[tuple(plain)] / n >= 0.9**merges - 0.03 and ways[tuple(plain)] < n
        assert ids == pieces.Segmenter(m, 0.1, 0).encode(text, 1)
        assert len({tuple(s.encode(text, *x)) for x in ((1, 0), (1, 1), (2, 0), (None, 0))}) == 4


def test_words_are_segmented_by_their_own_key():
    m = pieces.Pieces(PIECE)
    s, texts = pieces.Segmenter(m, 0.3, 5), [t for t in sample() if t] + ["international " * 300, "y" * 200]
    for doc_id, (text, got) in enumerate(zip(texts, s.encode_all(texts, [s.start(t, k) for k, t in enumerate(texts)]))):
        words = s.words(text)
        keys = s._keys(np.full(len(words), s.start(text, doc_id), np.uint64), np.arange(len(words)).astype(np.uint64))
        assert got.tolist() == [i for w, k in zip(words, keys.tolist()) for i in m.segment(w, k, s.limit)]


def test_copies_of_a_document_are_segmented_on_their_own(spark, tmp_path):
    from lectern.llm import queries

    text = "international understanding of characteristic segmentations " * 5
    fixture(spark, [text] * 4 + ["other words"] * 30, ids=[7] * 4 + list(range(8, 38))).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sorted((r.doc_id, tuple(r.ids)) for r in queries.encoding_stage(spark, docs, "").collect())
    assert len({ids for d, ids in got if d == 7}) == 4 and len(got) == 34
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        again = sorted((r.doc_id, tuple(r.ids)) for r in queries.encoding_stage(spark, docs, "").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == again
    chained = queries.encoding_stage(spark, docs.where("doc_id = 7").union(docs.where("doc_id = 7")), "").collect()
    assert len({tuple(r.ids) for r in chained}) == len(chained) == 8


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 10), (5, 5), (1000, 10**6), (3000, 2**62), (2000, 2001)):
        v = np.unique(r.integers(0, top, n))
        e = lm.EliasFano(len(v), *lm.EliasFano.encode(v))
        q = np.unique(np.concatenate([v, v + 1, np.maximum(v - 1, 0), r.integers(0, top, 500), [0, top]]))
        assert (e.successor(q) == np.searchsorted(v, q)).all() and (e.values() == v).all() and (e.at(np.arange(len(v))) == v).all()
        assert (e.find(q) == np.where(np.isin(q, v), np.searchsorted(v, q), -1)).all()


def test_lm_scores(docs):
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(w for i in texts if i not in held for w in texts[i])
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for i in texts if i not in held for p in zip([None, *texts[i]], texts[i]))
    pairs = {p: k for p, k in pairs.items() if k > 1}
    mass = collections.Counter()
    for (a, _), k in pairs.items():
        mass[a] += k - lm.DISCOUNT
    times = {**c, None: len(texts) - len(held)}
    for r in lm.scores(docs, 2, 2).collect():
        w = texts[r.doc_id]
        assert r.held_out == (r.doc_id in held) and r.train_tokens == n and r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        score = 0
        for a, b in zip([None, *w], w):
            p = (c[b] + 1) / (n + v + 1)
            if a in mass:
                p = p * (times[a] - mass[a]) / times[a] + max(pairs.get((a, b), 0) - lm.DISCOUNT, 0) / times[a]
            score += math.log10(p)
        assert abs(r.score - score) <= 1.2e-4 * len(w)  # half a step of the stored logarithms for each token


@pytest.mark.parametrize("order,least", [(3, 1), (3, 2), (4, 1)])
def test_lm_scores_of_longer_ngrams(docs, order, least):
    texts = {r.doc_id: [None, *(r.text or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    seen = [texts[i] for i in texts if i not in held]
    grams = [collections.Counter(tuple(t[j : j + k]) for t in seen for j in range(len(t) - k + 1)) for k in range(order + 1)]
    n, v = sum(len(t) - 1 for t in seen), len(grams[1]) - 1
    for k in range(2, order + 1):
        grams[k] = {g: c for g, c in grams[k].items() if c >= least and (k == 2 or g[:-1] in grams[k - 1])}
    mass = collections.Counter()
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            mass[g[:-1]] += c - lm.DISCOUNT
    for r in lm.scores(docs, order, least).collect():
        t, score = texts[r.doc_id], 0
        for j in range(1, len(t)):
            p = (grams[1][t[j],] + 1) / (n + v + 1)
            for k in range(2, min(order, j + 1) + 1):
                g = tuple(t[j - k + 1 : j + 1])
                if g[:-1] in mass:
                    times = grams[k - 1][g[:-1]]
                    p = p * (times - mass[g[:-1]]) / times + max(grams[k].get(g, 0) - lm.DISCOUNT, 0) / times
            score += math.log10(p)
        # Half a step of the stored logarithms for each level of each token.
        assert abs(r.score - score) <= 1.2e-4 * order * len(t)


def test_windows_of_texts_are_dealt_by_ranges_in_order(docs, monkeypatch):
    """One row a range and chunk of texts, not one a key; ranges rise with pairs, and a frequent word's pairs are in several."""
    r = np.random.default_rng(1)
    cuts = lm.Cuts([(0, 10), (1, 5 * lm.RANGE_TOKENS), (2, lm.RANGE_TOKENS // 2), (9, lm.RANGE_TOKENS)], 30, 7, 7 * lm.RANGE_TOKENS)
    first, second = np.divmod(np.unique(r.integers(0, 31 * 32, 900)), 32)
    got = cuts.ranges(first, second)
    assert (np.diff(got) >= 0).all() and len(set(got[first == 1])) > 2 and got.max() <= 7 and len(set(got[first == 5])) == 1
    for distinct in (7, 3_000_000):  # all symbols of a window in one number, and in two
        kind = lm.Windows(3, distinct)
        texts = [r.integers(0, 5, n) for n in (1, 2, 6, 40, 40)]
        want = collections.Counter(tuple([distinct, *t, distinct + 1][j : j + 3]) for t in map(list, texts) for j in range(len(t)))
        assert kind.columns == (1 if distinct == 7 else 2)
        rows, n = kind.counted(kind.packed(kind.of(texts)))
        again = lm._from_planes(b"".join(map(lm._planes, rows))), lm._from_sums(lm._sums(n))
        rows, n = kind.counted([np.concatenate([x, x]) for x in again[0]], np.concatenate([again[1]] * 2))
        grams = list(zip(*(s.tolist() for s in kind.symbols(rows))))
        assert grams == sorted(grams) and dict(zip(grams, (n // 2).tolist())) == want
    # With small ranges and files, many of each, scores are the same.
    before = {x.doc_id: x.score for x in lm.scores(docs).collect()}
    monkeypatch.setattr(lm, "RANGE_TOKENS", 512)
    monkeypatch.setattr(lm, "SLICE_TOKENS", 64)
    monkeypatch.setattr(lm, "PAIR_KEYS", 100)
    model = lm.train(docs.where(~lm.held_out()))
    assert len(model.files[2]) > 3 and len(model.files[3]) > 3
    assert {x.doc_id: x.score for x in lm.scored(docs, model).collect()} == pytest.approx(before)


def test_windows_of_many_words_take_few_bytes():
    """Where three words don't fit in one number, the third ones, which don't rise, take no more bytes than a word needs."""
    r = np.random.default_rng(2)
    sizes = {}
    for distinct in (1_000_000, 4_000_000):  # one number a window, and two
        kind = lm.Windows(3, distinct)
        rows, _ = kind.counted(kind.packed(kind.of([r.integers(0, distinct, 20_000)])))
        assert len(rows) == (1 if distinct == 1_000_000 else 2)
        told = list(map(lm._planes, rows))
        assert all((x == y).all() for x, y in zip(lm._from_planes(b"".join(told)), rows))
        sizes[distinct] = sum(map(len, told)) / len(rows[0])
    assert sizes[4_000_000] <= 1.5 * sizes[1_000_000]
    for v in ([7], [7, 3], [-5, 9, -5], [3, 3, 3], [0, 2**62, 1]):
        assert lm._from_planes(lm._planes(np.array(v)))[0].tolist() == v
    # Rows of several numbers come in their order where those fit together in one key, and where they don't.
    for top in (50, 2**62):
        rows = [r.integers(-top, top, 3000), r.integers(0, top, 3000)]
        got, n = lm.Windows(4, 2**31).counted([np.append(x, x) for x in rows], np.ones(6000, np.int64))
        want = collections.Counter(zip(*(np.append(x, x).tolist() for x in rows)))
        assert list(zip(*(x.tolist() for x in got))) == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def test_a_level_finds_contexts_by_number(spark):
    """Every context of a file has a pointer, those without followers too, so none is searched for; a file holds two sequences and two payloads."""
    docs = fixture(spark, ["a b c", "b c a b", "c", "", None, "a b d"] * 3)
    model = lm.train(docs, 4)
    for level in (2, 3, 4):
        for _, _, n, first, last, shapes in model.files[level]:
            assert len(shapes) == 2 * 5 + 2 and shapes[0] == last - first + 2 and shapes[5] == shapes[10] == n and shapes[11] == last - first + 1
        assert lm.Level(model.folder, level, model.files[level]).after(np.array([-1, 10**6]), np.array([0, 0]), model.distinct + 1)[0].tolist() == [-1, -1]


def test_lm_words_of_odd_texts(spark, monkeypatch):
    """Words are cut at 0x20 and 0x09-0x0D alone, and small parts of texts are put together."""
    odd = [" ", "  a  b ", "\ta\x0bB\x0cb\rb\n", "a\x1cb\x1fc", "a\u00a0b \u0085 \u3000", "\u00c4 \u00e4 A a \u0130", "a" * 5000, "", None, "x\x00y \x00"] * 4
    docs = fixture(spark, odd)
    want = {i: len((t or "").encode().lower().split()) + 1 for i, t in enumerate(odd)}
    got = lm.scored(docs, lm.train(docs)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.n_known == r.n_tokens and r.train_tokens == sum(want.values()) for r in got)
    monkeypatch.setattr(lm, "SPLIT_BYTES", 5)
    batch, at = docs.select("doc_id", "text").toArrow().to_batches(), {}
    for some in lm._texts(iter(batch), 10):
        for i, codes in zip(some.doc_ids, np.split(some.codes, np.cumsum(some.sizes)[:-1])):
            at[i] = [some.words[c] for c in codes]
    assert at == {i: [*(t or "").encode().lower().split(), lm.END] for i, t in enumerate(odd)}


def test_op10_has_contexts_of_two_words(spark, tmp_path):
    from lectern.llm import queries

    texts = ["a x b", "c x d"] * 20 + ["a x b", "a x d"] * 5
    fixture(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.op10_lm_scores(spark, str(tmp_path)).collect()}
    assert got[40] > got[41] + 0.2


def test_base_spans():
    text = "mail a.b+c@x-y.co.uk, @no @x.y q@z 10.0.0.1 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +1 (724) 555-7058 +12"
    got = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)]
    assert got == [("email", "a.b+c@x-y.co.uk"), ("ip", "10.0.0.1"), ("ip", "1.2.3.4"), ("phone", "+1 (724) 555-7058")]
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)] and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


def test_personal_data_model(spark):
    r = random.Random(4)
    texts = []
    for i in range(300):
        filler = lambda: " ".join(r.choice(("ther", "anin", "of", "eauon", "schich", "the")) for _ in range(r.randrange(3, 12)))
        item = (f"u{i}.{i % 99}@mail{i % 9}.example.com", f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", f"{r.randrange(1, 255)}.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(255)}", f"version {i % 9}.")[i % 4]
        texts.append(f"{filler()} {item} {filler()}.")
    got = {x.doc_id: x for x in pii.personal_data(fixture(spark, [*texts, None, ""])).collect()}
    assert len(got) == 302 and got[300].spans == got[301].spans == "" and got[300].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i, t in enumerate(texts):
        base = pii.told(pii.base_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert sum(got[i].n_added for i in range(3, 300, 4)) <= 7


def test_training_windows_do_not_depend_on_copies_or_on_what_is_common(spark):
    r = random.Random(6)
    pad = lambda: "".join(r.choice("etaoinsh ") for _ in range(40))
    rare = [f"{pad()} {item}" for i in range(12) for item in (f"u{i}@host{i}.example.com", f"10.0.{i}.1 up")]
    common = [f"{pad()} {r.randrange(10**6)} of it" for _ in range(2000)]
    got = pii.training_windows(fixture(spark, [*rare, *common, *["copied 1 line"] * 3000]), most=80)
    negatives = [w for w, s in got if not s]
    kinds = collections.Counter(s[0][0] for _, s in got if s)
    assert len(set(negatives)) == len(negatives) and 40 <= len(negatives) <= 70
    assert kinds[0] >= 10 and kinds[1] >= 10


def test_altered_cards_keep_their_digits():
    text = "pay 4111 1111 1111 1111 now"
    for turn in range(5):
        new, spans = pii._altered(text, [(2, 4, 23)], turn)
        kind, a, b = spans[0]
        assert kind == 2 and "".join(c for c in new[a:b] if c.isdigit()) == "4111111111111111" and new[b:] == " now"
        assert [len(x) for x in new[a:b].replace("  ", " ").replace("-", " ").replace(".", " ").replace("/", " ").split()] == [4, 4, 4, 4]


def test_tagger_learns_held_out_windows(spark):
    r = random.Random(7)

    def window():
        a, b = "".join(r.choice("etaoinsh ") for _ in range(r.randrange(2, 18))), "".join(r.choice("etaoinsh ") for _ in range(10))
        item = f"{r.randrange(1, 255)}.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(255)}"
        return f"{a} {item} {b}", [(1, len(a) + 1, len(a) + 1 + len(item))]

    model = pii.Tagger(0).fit([window() for _ in range(300)])
    held = [window() for _ in range(60)]
    assert sum(set(model.spans(t)) == set(s) for t, s in held) >= 50


def test_token_files_are_queried(spark, docs, tmp_path):
    folder = str(tmp_path / "shards")
    wavelet.write_shards(docs, BPE, folder, 2, shard_tokens=700)
    shards, t = wavelet.read_shards(spark, folder), Tokenizer.from_file(BPE)
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert shards.count() > 3
    wanted = [(i, at) for i, v in ids.items() for at in {0, len(v) // 2, len(v) - 1, len(v), -1}] + [(10_000, 0), (0, 0)]
    got = wavelet.accessed(shards, spark.createDataFrame(wanted, "doc_id long, at long")).collect()
    assert {(r.doc_id, r.at): r.token for r in got} == {(i, at): ids[i][at] for i, at in wanted if i in ids and 0 <= at < len(ids[i])} and len({(r.doc_id, r.at) for r in got}) == len(got)
    common = collections.Counter(x for v in ids.values() for x in v)
    some = [2, common.most_common(3)[1][0], max(common), 49_999, 1 << 20]
    assert {r.token: r.n for r in wavelet.counted(shards, some).collect()} == {x: common[x] for x in some}
    rare = common.most_common(9)[8][0]
    assert sorted(map(tuple, wavelet.located(shards, rare).collect())) == sorted((i, at) for i, v in ids.items() for at, x in enumerate(v) if x == rare)
    assert wavelet.located(shards, 1 << 20).count() == 0


def test_stages_take_an_empty_table(spark, empty):
    import corpus_pipeline

    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and (k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_the_model_finds_what_the_patterns_miss_and_leaves_look_alikes():
    r = random.Random(21)
    bits = ("ther", "anin", "of", "eauon", "schich", "the", "los", "que", "is", "and")
    texts = [" ".join(r.choice(bits) for _ in range(30)) for _ in range(60)]
    model = pii.Tagger(0).fit(pii.generated(texts, seed=1), seed=0)
    right, wrong, total = collections.Counter(), 0, collections.Counter()
    for i in range(200):
        kind, item = i % 4, pii.written_out(i % 4, r)
        head, tail = " ".join(r.choice(bits) for _ in range(r.randrange(1, 20))) + " ", " " + " ".join(r.choice(bits) for _ in range(r.randrange(1, 20)))
        base, every = pii.find(head + item + tail, model)
        total[kind] += 1
        right[kind] += (kind, len(head), len(head) + len(item)) in every and not base
        base, every = pii.find(head + pii.look_alike(r) + tail, model)
        wrong += len(every) > len(base)
    assert all(right[k] >= 0.6 * total[k] for k in total) and sum(right.values()) >= 150, right
    assert wrong <= 6


def test_added_spans_begin_and_end_with_what_they_hold():
    assert pii._trimmed((1, 0, 14), "* 10 . 0 . 0 . 1"[:14]) == (1, 2, 12) and pii._trimmed((3, 1, 15), "a (724) 555-7058 b") == (3, 2, 15)
    assert pii._trimmed((0, 0, 19), "(bob @ example.com)") == (0, 1, 18)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = ["\n".join(" ".join(r.choice(words) for _ in range(20)) + "." for _ in range(5)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more.", None, "", "x | y | z " * 50]
    fixture(spark, texts, [f"s{i % 7}" for i in range(len(texts))]).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if k == 2:
            assert {x.doc_id for x in docs.collect()} == set(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(x.lossless for x in out)
    assert sorted(x.position for x in out) == list(range(len(out)))
    assert [x.doc_id for x in sorted(out, key=lambda x: x.position)] == [x.doc_id for x in placed(docs).orderBy("place").select("row.doc_id").collect()]
