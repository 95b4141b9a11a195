import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import language_id, line_dedup, matroska, mixing, ngram_join, quality, substring_dedup, token_counts, toxicity
from quarry.llm.words import scramble, shingles
from test_decontamination import within

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_TOKENS2 int, score double, component_id long"
LONG = "\n".join(f"row {i} of a very long text" for i in range(5000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None, 1, 2.0, 3) for i, t, l, s in rows], SCHEMA)


EDGE = [(1, None, None, None), (2, "", "en", "src1"), (3, "a\nb\nc\nd", "en", "src1"), (4, "x\na\nb\nc\ny", "en", "src1"), (4, "x\na\nb\nc\ny", "en", "src1"), (None, "a\nb\nc", "en", "src2"), (5, LONG, "fr", "src3"), (6, " \n\t", None, "other")]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, EDGE).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 1), (5, None, None), (None, 1, 1)], LABELS)


def test_line_dedup(spark, edge):
    got = line_dedup.line_dedup(edge)
    assert "component_id" in got.columns
    rows = defaultdict(list)
    for r in got.collect():
        rows[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert rows[4] == [("x\ny", 5, 3)] * 2
    assert rows[1] == [(None, 0, 0)] and rows[2] == [("", 1, 0)] and rows[None] == [("a\nb\nc", 3, 0)]
    assert rows[5][0][0] == LONG
    assert line_dedup.line_dedup(edge.limit(0)).count() == 0


def test_row_operators_take_every_row(spark, edge, labels):
    n = len(EDGE)
    for out in (toxicity.toxicity(edge, labels), quality.quality_scores(edge, labels), language_id.language_id(edge), token_counts.token_counts(edge, [b"a", b"ro", b"row"]), matroska.media_columns(edge)):
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(e[0]) for e in EDGE)
        if "score" in out.columns:
            assert all(0 <= r.score <= 1 for r in rows)
    assert len(quality.keep_good(edge, labels.limit(0)).collect()) == n
    for out in (toxicity.toxicity(edge.limit(0), labels), language_id.language_id(edge.limit(0))):
        assert out.count() == 0
    und = {r.doc_id: r.lang_pred for r in language_id.language_id(edge).collect()}
    assert und[1] == und[2] == und[6] == "und"


def test_media_round_trip():
    for size in (0, 1, 63, 64, 65, 512, 4096, 32768, 40001):
        text = "é" * (size // 2) + "x" * (size % 2)
        n, media = matroska.store(text)
        _, packets, cues = matroska.parse(media)
        back = b"".join(media[p.offset : p.offset + p.size] for p in packets)
        assert n == size and len(back) == max(64, -(-size // 64) * 64) and back[:n].decode() == text and not any(back[n:])
        assert len(cues) == len({p.cluster for p in packets})
        d = matroska.digest(text)
        assert d[2] == hashlib.sha256(back).hexdigest() and d[3] == zlib.crc32(back[-64:])
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        for sizes in ([5, 300, 2, 70000], [0, 0, 1], [255, 255, 510]):
            data = matroska.write_lacing(sizes, lacing) + bytes(sum(sizes))
            assert matroska.laced_sizes(data, 0, len(data), lacing)[0] == sizes


def test_packet_tables(spark):
    files = spark.createDataFrame([(1, bytearray(matroska.mux(b"ab" * 3000))), (2, bytearray(b"junk")), (3, None)], "file_id long, content binary")
    rows = matroska.packet_tables(files).collect()
    assert sum(r.byte_end - r.byte_start for r in rows if r.file_id == 1) == 6000
    assert [r.error is None for r in rows if r.file_id != 1] == [False, False]


def test_longest_match_is_greedy():
    tokens = [b"a", b"ab", b"abc", b"bcd", b"abcdx", b"dx", b"cc"]
    automaton, known = token_counts.LongestMatch(tokens), {*tokens, *(bytes([b]) for b in range(256))}

    def greedy(p):
        n = 0
        while p:
            k = next(k for k in range(min(5, len(p)), 0, -1) if p[:k] in known)
            p, n = p[k:], n + 1
        return n

    rng = random.Random(1)
    for _ in range(3000):
        p = bytes(rng.choice(b"abcdx") for _ in range(rng.randint(0, 14)))
        assert automaton.count(p) == greedy(p)


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))


def test_ngram_join_against_brute_force(spark):
    rng, rows = random.Random(2), []
    base = [words(rng, 60).split() for _ in range(6)]
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(200, None, None, None), (201, "", "en", "s"), (202, "One two", "en", "s"), (203, "one  TWO", "en", "s"), (None, "one two", "en", "s"), (0, rows[0][1], "en", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs(spark, rows), 4, 85).collect()}
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
    assert got == {i: (len(s), group[i]) for i, s in sets.items()}


def test_substring_dedup_finds_planted_passages(spark):
    rng = random.Random(3)
    shared, other = words(rng, 70), words(rng, 55)
    near = shared.split()
    near[30] = "zzz"
    rows = [(i, words(rng, 80), "en", "s") for i in range(20)]
    rows += [(100 + i, f"{words(rng, 40)} {p} {words(rng, 40)}", "en", "s") for i, p in enumerate([shared, shared, " ".join(near), other, other])]
    rows += [(300, None, None, None), (301, "short", "en", "s"), (None, shared, "en", "s")]
    got = substring_dedup.near_duplicate_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} | {r.partner_id for r in got} == {100, 101, 102, 103, 104}
    hit = next(r for r in got if r.doc_id == 101)
    assert hit.first_word <= 40 and hit.last_word >= 109 and hit.similarity >= 0.8
    assert substring_dedup.near_duplicate_passages(docs(spark, rows).limit(0)).count() == 0


def shingled(*parts):
    return shingles(scramble(np.concatenate([np.asarray(p, np.uint64) for p in parts])), 5)


def alike(a, b, least, percent):
    """Whether any two runs, the first of `least` or more, have the similarity; of distinct shingles, shared ones in the same places."""
    shared = np.append(0, np.cumsum(a == b))
    p, q = np.triu_indices(len(b) + 1, 1)
    for i in range(len(a) - least + 1):
        for j in range(i + least, len(a) + 1):
            same = np.maximum(0, shared[np.minimum(j, q)] - shared[np.maximum(i, p)])
            if (100 * same >= percent * (j - i + q - p - same)).any():
                return True
    return False


@pytest.mark.parametrize("n", [50, 54, 60, 64, 80])
def test_passages_with_changed_words_against_brute_force(n):
    rng = random.Random(n)
    changed = [(c,) for c in range(n)] + [tuple(rng.sample(range(n), 2)) for _ in range(30)]
    for at in changed:
        other = np.arange(n)
        other[list(at)] += 1000
        a, b = shingled(np.arange(n)), shingled(other)
        got = list(substring_dedup.passages(a, b, 46, 80))
        assert bool(got) == alike(a, b, 46, 80), at
        for lo, hi, p, q, sim in got:
            x, y = set(a[lo:hi].tolist()), set(b[p:q].tolist())
            assert hi - lo >= 46 and len(x & y) / len(x | y) == sim >= 0.8


def test_passages_whose_counterparts_are_scattered():
    first, second = np.arange(60), np.arange(100, 160)
    new = iter(np.arange(1000, 10**6))

    def some(n):
        return [next(new) for _ in range(n)]

    def found(a, b):
        return sorted(g[:4] for g in substring_dedup.passages(shingled(*a), shingled(*b), 46, 80))

    assert found([some(5), first, some(5)], [first, some(30), first[10:15], some(3)]) == [(5, 61, 0, 56)]
    assert found([some(5), first, some(9)], [first, some(130), first]) == [(5, 61, 0, 56)]
    assert found([first, second], [some(3), second, some(200), first]) == [(0, 56, 263, 319), (60, 116, 3, 59)]
    assert found([first, some(2), second], [first, some(200), second]) == [(0, 56, 0, 56), (62, 118, 260, 316)]
    line = np.arange(200, 206)
    a, b = ([x for _ in range(300) for x in (line, some(6))] for _ in range(2))
    assert {g[0] >= 3600 and g[1] <= 3662 for g in found([*a, first, *a], [*b, some(9), first, *b])} >= {True}
    assert found([line] * 3000, [line] * 2000)


def test_substring_dedup_functions_find_windows_at_the_similarity():
    n, p = substring_dedup.HASHES, substring_dedup.PERCENT / 100
    missed = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(substring_dedup.NEEDED))
    assert missed <= 0.01
    half = sum(math.comb(n, k) for k in range(substring_dedup.NEEDED)) / 2**n  # where half of the functions lose their link
    assert half <= 0.125


def test_mixing_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else None, f"src{i % 5}") for i in range(300)] + [(900, None, "en", "src1"), (None, "w", "en", "src1")]
    got = mixing.mix(docs(spark, rows), mixing.default_levels(), mixing.WEIGHTS, 0.5, 2, 1).collect()
    supply = sum(1 + i % 7 for i in range(300))
    taken = sum(r.n_tokens * r.epochs + r.last_tokens for r in got)
    assert supply // 2 - 60 <= taken <= supply // 2 and len({r.doc_id for r in got}) == len(got)
    assert mixing.mix(docs(spark, rows).limit(0), mixing.default_levels(), {}, 0.5).count() == 0


def test_models_learn():
    rng = random.Random(5)
    texts = [words(rng, 30) + (" idiot" if i % 8 == 0 else "") for i in range(400)]
    toxic = np.array([i % 8 == 0 for i in range(400)])
    score = toxicity.ToxicityModel(texts, toxic).score([words(rng, 30) + " idiot", words(rng, 30), None])
    assert score[0] > 0.3 > score[1] and score[2] < 0.3
    good = np.stack([quality.features(words(rng, 50)) for _ in range(300)])
    bad = np.stack([quality.features(words(rng, 50).upper().replace(" ", "!! ")) for _ in range(100)])
    model = quality.PuModel(good[:150], np.concatenate([good[150:], bad]), steps=400)
    assert (model.score(good[:50]) >= 0.7).mean() > 0.9 and (model.score(bad) < 0.7).mean() > 0.9
    learned = [language_id.ngram_counts(t) for t in ("abcab abc " * 9, "xyzzy xyz " * 9)]
    p = language_id.Profiles(["aa", "xx"], language_id.unit_vectors(learned, language_id.letter_vectors(language_id.DIM, 7)))
    assert p.predict(["abc abcab", "zyx xyzzy", "12", None])[0] == ["aa", "xx", "und", "und"]
    assert language_id.ngram_counts("ab cd")[1].sum() == 5


def test_word_hashes_of_slices():
    from quarry.llm.words import shingle_sets

    texts = pa.array(["One two three four five six", None, "", "one TWO\tthree four five six", " x"])
    whole = [s.tolist() for s in shingle_sets(texts, 5)]
    assert whole[0] == whole[3] and len(whole[0]) == 2 and whole[1] == whole[2] == [] and len(whole[4]) == 1
    assert [s.tolist() for s in shingle_sets(texts.slice(3, 2), 5)] == whole[3:]


def plain_stages(rows, items):
    """Line dedup, near duplicates and decontamination of (doc_id, text), in plain Python."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if window in seen else set()
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in out.items() if (w := t.lower().split())}
    group = {i: i for i in out}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
    out = {i: t for i, t in out.items() if group[i] == i}
    bad = {d for d, _ in within(list(out.items()), items, lambda n: n)}
    return {i: t for i, t in out.items() if i not in bad}


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, words(rng, 20) + ". " + words(rng, 6) + ".") for i in range(5)]
    texts = {i: "\n".join(words(rng, 12) for _ in range(8)) for i in range(12)}
    texts[20] = "\n".join([words(rng, 9), *texts[3].split("\n")[2:6], words(rng, 9)])
    copy = words(rng, 100).split()
    texts[21], texts[22] = " ".join(copy), " ".join(copy[:50] + ["zzz"] + copy[51:])
    texts[23] = f"{words(rng, 90)} {items[1][1]} {words(rng, 20)}"
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in texts.items()], kinds)
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labelled = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(12)], LABELS)
    labelled.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    table, stored = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    good = {r.doc_id: texts[r.doc_id] for r in quality.quality_scores(table, stored).where("predicted = 1").collect()}
    for kept, labels in ((good, labelled), (texts, labelled.limit(0))):
        labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet") if labels is not labelled else None
        left = plain_stages(kept, items)
        mixed = mixing.mixed_documents(spark.createDataFrame([(i, t, "en", "src1", len(texts[i])) for i, t in left.items()], kinds))
        got = corpus_pipeline.run(spark, str(tmp_path))
        assert got.columns == mixed.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in mixed.collect()}
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixed.collect()))
    assert not {22, 23} & set(left) and left[20].count("\n") == 1 and len(left) == 14
