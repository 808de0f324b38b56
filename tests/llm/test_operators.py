"""The training-data operators against brute force, exact round trips and held-out labels, with the odd cases of each."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, decontaminate, neardup, quality, registry, sharding, substring, tokenfiles, toxicity, warc
from tests.oracle import SF, same

ORACLE, QUERIES = registry.oracle_sql(), registry.queries()
WORDS = [f"w{i}" for i in range(60)]
_word = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [x.decode() for x in _word.findall((text or "").encode())]


def corpus(n=60, seed=3):
    """(doc_id, text) with copies, near copies, shared passages, blanks, nulls and long texts."""
    r = random.Random(seed)
    rows = []
    passage = " ".join(r.choice(WORDS) for _ in range(50))
    for i in range(n):
        kind = i % 10
        if kind == 0 and i:
            text = rows[r.randrange(len(rows))][1]
        elif kind == 1 and i > 10:
            w = words(rows[r.randrange(len(rows))][1])
            for _ in range(max(1, len(w) // 60)):
                if w:
                    w[r.randrange(len(w))] = "zz" + str(i)
            text = " ".join(w)
        elif kind == 2:
            text = [None, "", " \t\n", "One two", "É à\x0bç", "a b c d e"][(i // 10) % 6]
        elif kind == 3:
            text = " ".join(r.choice(WORDS) for _ in range(20)) + "\n" + passage + "  " + " ".join(r.choice(WORDS) for _ in range(20))
        elif kind == 4:
            text = "again and again the line\n" * r.randrange(1, 9) + "x # * y"
        elif kind == 5 and i > 40:
            text = " ".join(r.choice(WORDS) for _ in range(3000))
        else:
            text = " ".join(r.choice(WORDS) for _ in range(r.randrange(5, 200)))
        rows.append((i, text))
    return rows


def frame(spark, rows):
    """The rows with extra columns, some named like columns that operators make."""
    return spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id long, text string, h string, k long, id long").repartition(3)


def near_brute(rows):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = _word.findall((t or "").encode().translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates(spark):
    rows = corpus(80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_near_duplicates_where_centres_miss(spark):
    """A family in which most pairs are below the threshold: links must not depend on the centre."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(150)] = f"m{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_repeated_rows_are_copies(spark):
    got = neardup.near_duplicates(frame(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (None, "q"), (9, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (7, 7), (7, 7), (9, 7)]


def test_one_id_with_two_texts_is_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " tail"), (2, b), (5, b + " tail"), (5, b + " tail"), (6, c), (7, None), (7, c + " tail"), (8, " ")]
    got = sorted({(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()})
    assert got == [(1, 1, True), (2, 1, False), (5, 1, False), (6, 6, True), (7, 6, False), (7, 7, True), (8, 8, True)]


def test_large_bucket_in_slices(spark, monkeypatch):
    """Slices of a bucket's members lose no pair."""
    monkeypatch.setattr(neardup, "SLICE", 3)
    monkeypatch.setattr(neardup, "PEELS", 0)
    r = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(120)] = f"m{r.randrange(7)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_brute(rows)


def quality_brute(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n")]
    seen, dup = set(), 0
    for x in lines:
        if x in seen and words(x):
            dup += 1
        seen.add(x)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(tri)
    many = {t for t in tri if times[t] > 1}
    covered = {j for i, t in enumerate(tri) if t in many for j in (i, i + 1, i + 2)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, rep, n < 50 or 100 * rep > 50 * n


def test_quality(spark):
    rows = corpus(60)
    rows += [(700, rows[6][1]), (701, "long word " * 60_000), (702, "x" * 200_000), (703, "\n" * 5000 + "a\n" * 5000), (6, rows[6][1])]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.repetition_coverage(frame(spark, rows)).collect()}
    assert got == {i: quality_brute(t) for i, t in rows}
    assert all(not r.kept for r in quality.repetition_coverage(frame(spark, rows)).where("base_failed").collect())
    assert quality.repetition_coverage(frame(spark, []).limit(0)).count() == 0


TEXTS = ["", "a   b", "  a", "a  ", "\n\n b  c\t d", "don't 's    x", "\x00\x01 a\r\n b", "é" * 300 + " " * 50 + "x", "12 345  67", "日本語 テキスト", "<|endoftext|> x", "thonninti the\xa0x \xa0 y"]


def test_byte_bpe_equals_the_library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.ByteBPE(*bpe._default_vocabulary())
    texts = TEXTS + [t or "" for _, t in corpus(40)]
    for _ in range(2):
        ids = mine.encode_batch(texts)
        assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
        assert [mine.decode(x) for x in ids] == [t.encode() for t in texts]
        mine.memory.limit = 50  # the memory forgets, results stay
        mine.memory._shrink()


def test_long_pieces():
    """One letter run of a megabyte takes seconds; shorter ones equal the matrices and the library."""
    import time

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, r = bpe.ByteBPE(*bpe._default_vocabulary()), random.Random(6)
    pieces = ["a" * 3000, "ab" * 700, "é" * 900, "".join(r.choice("etaoinshr") for _ in range(5000)), "".join(r.choice("ab") for _ in range(513)), "-" * 2000, "1" * 1500]
    assert [x.tolist() for x in mine.encode_batch(pieces)] == [library.encode_ordinary(t) for t in pieces]
    some = [p.encode()[:700] for p in pieces]
    rows = np.array([mine.byte_id[np.frombuffer(p, np.uint8)] for p in some if len(p) == 700])
    assert [x.tolist() for x in mine._merge_rows(rows, np.full(len(rows), 700))] == [mine._merge_long(p).tolist() for p in some if len(p) == 700]
    began = time.time()
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    assert mine.decode(mine.encode_batch([text])[0]).decode() == text and time.time() - began < 60


def test_bpe_query_forms(spark):
    df = frame(spark, list(enumerate([*TEXTS, None])))
    back = {r.doc_id: r.decoded.decode() for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == dict(enumerate([*TEXTS, ""]))
    one = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(df).collect()}
    assert one == {r.doc_id: hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in bpe.encode(df).collect()}
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2), (511, 3), (513, 70000), (4000, 300)):
        a = rng.integers(0, top, n)
        w = tokenfiles.WaveletMatrix.build(a)
        assert (w.ids() == a).all()
        for v in {int(a[0]), int(a[-1]), top - 1, top + 5}:
            at = np.flatnonzero(a == v)
            assert w.count(v) == len(at)
            assert [w.rank(v, i) for i in (0, n // 2, n)] == [int((a[:i] == v).sum()) for i in (0, n // 2, n)]
            assert [w.select(v, k) for k in range(min(5, len(at)))] == at[:5].tolist()
            assert w.select(v, len(at)) == -1
        assert [w.access(i) for i in range(0, n, 97)] == a[::97].tolist()
        assert (w.access_many(np.arange(n)) == a).all()


def test_wavelet_file_is_read_in_parts(tmp_path):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50_000, 1_000_000).astype(np.uint16)
    ends = np.array([10, 400_000, 1_000_000])
    tokenfiles.write_shard(f"{tmp_path}/x.wvm", a, ends, [5, 6, None])
    w, got_ends, names = tokenfiles.open_shard(f"{tmp_path}/x.wvm")
    assert got_ends.tolist() == ends.tolist() and names == [5, 6, None]
    for i in (0, 77, 511, 512, 262_144, 999_999):
        assert w.access(i) == a[i]
    assert sum(len(p.held) for p in w.planes) <= 6 * len(w.planes) < sum(-(-len(p) // tokenfiles.FRAME) for p in w.planes) * 2
    v = int(a[123_456])
    at = np.flatnonzero(a == v)
    assert w.count(v) == len(at) and w.rank(v, 500_000) == (at < 500_000).sum() and w.select(v, 3) == at[3]
    assert (w.ids() == a).all() and (w.access_many(at) == v).all()


def test_token_files_odd_ids(spark, tmp_path):
    rows = [(None, "x y"), (3, "b"), (3, "a"), (3, "a"), (1, None), (2, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, id int, path string")
    got = sorted(tokenfiles.read_files(tokenfiles.write_files(df, f"file://{tmp_path}/o")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3] and got[1].n_tokens == 1
    assert all(x.start + x.n_tokens == y.start for x, y in zip(got, got[1:]))


def test_token_files(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = corpus(50) + [(100 + i, x) for i, x in enumerate(TEXTS)]
    start, want = 0, []
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfiles.read_files(tokenfiles.write_files(frame(spark, rows), f"file://{tmp_path}/w")).collect()
    assert sorted(map(tuple, got)) == want
    assert tokenfiles.read_files(tokenfiles.write_files(frame(spark, []).limit(0), f"file://{tmp_path}/e")).count() == 0


def substring_brute(rows, n=35):
    at = {}
    split = [(i, words(t)) for i, t in rows]
    for k, (_, w) in enumerate(split):
        for s in range(len(w) - n + 1):
            at.setdefault(tuple(w[s : s + n]), []).append((k, s))
    gone = [set() for _ in split]
    for places in at.values():
        if len(places) > 1:
            for k, s in places:
                gone[k].update(range(s, s + n))
    return sorted((i, len(w), len(g), " ".join(x for j, x in enumerate(w) if j not in g)) for (i, w), g in zip(split, gone, strict=True))


def test_substring_dedup(spark):
    rows = corpus(70) + [(200, "p q r " * 40), (201, "x y " + "p q r " * 13), (5, "same " * 40), (5, "same " * 40)]
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(frame(spark, rows)).collect())
    assert got == substring_brute(rows)
    assert substring.substring_dedup(frame(spark, []).limit(0)).count() == 0


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """A sketch far too small for its anchors flags more windows, and the result stays."""
    assert [substring.sketch_bits(n) for n in (0, 10**9, 10**15)] == [22, 25, 27]
    rows = corpus(70)
    monkeypatch.setattr(substring, "sketch_bits", lambda n: substring.BLOCK_BITS)
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(frame(spark, rows)).collect())
    assert got == substring_brute(rows)


def test_containment_both_ways(spark):
    rows = corpus(50)
    items = [(0, rows[6][1][:150]), (1, "One two"), (2, None), (3, " "), (4, " ".join(WORDS[:30])), (5, rows[7][1]), (6, (rows[46][1] or "")[:900])]
    b = spark.createDataFrame(items, "item_id long, text string")

    def shingles(t):
        w = words((t or "").lower())
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = sorted((i, j, len(shingles(x)), len(shingles(x) & shingles(t))) for i, t in rows for j, x in items if shingles(x) and 100 * len(shingles(x) & shingles(t)) >= 75 * len(shingles(x)))
    assert want
    for bits in (decontaminate.MOST_BITS, 8):  # a full table lets everything through to the joins
        got = decontaminate.contained_items(frame(spark, rows), b, most_bits=bits).collect()
        assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got) == want
    assert decontaminate.contained_items(frame(spark, []).limit(0), b).count() == 0
    assert decontaminate.contained_items(frame(spark, rows), b.limit(0)).count() == 0


def test_items_of_all_sizes_at_the_threshold(spark):
    """Documents that hold just enough, and just too little, of items of 5 to 2000 shingles; the recall must be whole."""
    r = random.Random(8)
    items, rows, want = [], [], set()
    for k, n in enumerate([5, 8, 13, 20, 33, 64, 129, 500, 2000]):
        w = [f"i{k}x{j}" for j in range(n + 4)]
        items.append((k, " ".join(w)))
        need = -(-75 * n // 100)
        for trial in range(6):
            for share, inside in ((need, True), (need - 1, False)):
                at = r.randrange(n - share + 1)
                doc = [r.choice(WORDS) for _ in range(30)] + w[at : at + share + 4] + [r.choice(WORDS) for _ in range(30)]
                rows.append((len(rows), " ".join(doc).upper() if trial % 2 else "\n".join(doc)))
                if inside:
                    want.add((len(rows) - 1, k))
    rows += [(3, rows[3][1]), (900, None)]
    b = spark.createDataFrame(items + [(0, items[0][1])], "item_id long, text string")
    got = decontaminate.contained_items(frame(spark, rows), b)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    keyed = b.select("item_id", F.xxhash64("text").alias("item_row"), F.col("text").alias("t"))
    by = {x.n: x.k for x in decontaminate.signatures(keyed).dropDuplicates(["item_id", "h"]).groupBy("item_id", "n").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert all(k <= 0.6 * n for n, k in by.items() if n >= 8) and by[2000] == 516
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_items_inside_longer_texts(spark):
    items = {1: "w1", 2: "Zebra crossing", 3: "a b c", 4: "one two three four", 5: "one two three four five", 6: " "}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(1, "see the zebra\ncrossing over there now"), (2, "zebra of the crossing and more words"), (3, "x a b c"), (4, "b c a b"), (5, "zero one two three four six w1"), (6, "one two three four five"), (7, "w1"), (8, "w11 w12 w13 w14 w15 w16"), (9, None), (10, "zebra  crossing")]
    runs = {i: {tuple(words((t or "").lower())[j : j + k]) for k in range(1, 6) for j in range(len(words(t)) - k + 1)} for i, t in rows}
    want = {(i, k) for i in runs for k, t in items.items() if tuple(words(t.lower())) in runs[i]}
    for bits in (decontaminate.MOST_BITS, 8):
        got = decontaminate.contained_items(frame(spark, rows), b, most_bits=bits).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and {(x.n_item_shingles, x.n_shared, x.containment) for x in got} == {(1, 1, 1.0)}


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s>", "a</s", "", "[INST]" * 3]
    rows = [(c, i, ["system", "user", "assistant"][(c + i) % 3], random.Random(c * 9 + i).choice(odd + ["plain é"])) for c in range(12) for i in range(c)]
    rows += [(50, 0, "user", None), (51, 0, None, "x"), (None, 0, "assistant", "y"), (52, 0, "assistant", "z"), (52, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    e = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(e).collect()}
    by = {}
    for c, i, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        replies = "".join(t for role, t in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(replies), hashlib.sha256(replies.encode()).hexdigest())
    for x in e.where("loss_start IS NOT NULL").collect():
        turns = chat.parse(x.formatted)
        assert len(turns) == x.n_turns and turns[-1] == ("assistant", chat.unescape(x.formatted[x.loss_start : x.loss_end]))
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def test_chat_long_conversation_and_odd_order(spark):
    """A long conversation among short ones, extra columns, and examples whose rows come back in another order."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(400)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], "conv_id long, turn long, role string, text string, example int, formatted string")
    e = chat.expand(df)
    want = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in chat.read_back(e).collect()}
    assert want[1][0] == 400 and want[2][0] == 1
    shuffled = e.repartition(3, "example").sortWithinPartitions(F.desc("example"))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in chat.read_back(shuffled, regroup=True).collect()} == want


def test_warc_pushdown_and_ranges(spark, tmp_path):
    big = "é" * 900
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/4", "x"), (5, "http://a/5", "x"), (6, "http://a\r\nb", big + "!")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.digests(warc.read_archives(spark, folder), warc.read_archives(spark, folder, payload=False)).collect()}
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    assert got == {i: ("revisit" if i == 1 else "response", 2 if i == 1 else None, len((h or "").encode()), sha(h)) for i, _, h in pages}
    only = warc.read_archives(spark, folder).where("record_type = 'revisit'")
    assert [r.page_id for r in only.collect()] == [1]
    reader = warc.WarcReader({"path": folder, "splitBytes": "300"})
    list(reader.pushFilters([warc.EqualTo(("record_type",), "response")]))
    assert reader.wanted == [("record_type", frozenset(["response"]))]
    parts = reader.partitions()
    assert len(parts) > 2
    ids = sorted(i for p in parts for b in reader.read(p) for i in b.column("page_id").to_pylist())
    assert ids == [2, 3, 4, 5, 6]
    assert warc.read_archives(spark, folder, payload=False).where("payload IS NOT NULL").count() == 0


def test_warc_inflates_headers_only(tmp_path):
    import io

    big = "".join(chr(33 + (i * 7919) % 90) for i in range(200_000))
    raw = b"".join(warc.member(warc.render(i, "http://a", big if i % 2 else "x", "response", None, "00" * 20)) for i in range(4))
    inflated = []
    kept = list(warc.scan(io.BytesIO(raw), 0, len(raw), lambda h: h["x-page-id"] == "3", True, inflated))
    assert [(h["x-page-id"], p.decode()) for h, p in kept] == [("3", big)]
    assert max(inflated[:3]) <= warc.HEAD_STEP < inflated[3]
    inflated = []
    assert all(p is None for _, p in warc.scan(io.BytesIO(raw), 0, len(raw), lambda h: True, False, inflated)) and max(inflated) <= warc.HEAD_STEP


def test_warc_of_other_writers(spark, tmp_path):
    """Gzip members without a skip length and plain records, in a nested folder."""
    import gzip

    def record(kind, uri, body, http=True):
        block = (b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" if http else b"") + body
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{warc._b32(hashlib.sha1(body).hexdigest())}\r\n"
        return head.encode() + f"Content-Type: application/{'http' if http else 'warc-fields'}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record("warcinfo", "u0", b"software: x", False), record("response", "u1", b"p" * 5000), record("metadata", "u2", b"\r\n\r\nWARC/1.0 inside", False), record("response", "u3", b"")]
    folder = tmp_path / "w" / "2020" / "01"
    folder.mkdir(parents=True)
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (folder / "b.warc").write_bytes(b"".join(records))
    got = warc.read_archives(spark, f"file://{tmp_path}/w")
    want = [("response", "u1", 5000, hashlib.sha1(b"p" * 5000).hexdigest(), b"p" * 5000), ("response", "u3", 0, hashlib.sha1(b"").hexdigest(), b"")]
    mine = sorted((r.record_type, r.url, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got.where("record_type = 'response'").collect())
    assert mine == sorted(want * 2)
    assert sorted(r.url for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()) == sorted(["u0", "u1", "u2", "u3"] * 2)
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w", "splitBytes": "500"})
    assert sorted(u for p in reader.partitions() for b in reader.read(p) for u in b.column("url").to_pylist()) == sorted(["u0", "u1", "u2", "u3"] * 2)


def test_warc_odd_tables(spark, tmp_path):
    big = "z" * 1500
    rows = [(1, "u", big), (1, "u", big), (None, "u", big), (7, None, ""), (8, "v", "y" * (9 << 20))]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, record_type string, n int")
    read = lambda d, name: (warc.write_archives(d, f"file://{tmp_path}/{name}"), warc.digests(warc.read_archives(spark, f"file://{tmp_path}/{name}"), warc.read_archives(spark, f"file://{tmp_path}/{name}", payload=False)).collect())[1]
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in read(df, "a")), key=str)
    assert got == sorted([(1, "response", None, 1500), (1, "response", None, 1500), (0, "revisit", 1, 1500), (7, "response", None, 0), (8, "response", None, 9 << 20)], key=str)
    assert read(df.limit(0), "b") == []


def test_hilbert_curve_steps_by_one():
    import itertools

    p = np.array(list(itertools.product(range(8), repeat=3)))
    h = sharding.hilbert_index(p, 3)
    assert sorted(h) == list(range(512))
    assert np.abs(np.diff(p[np.argsort(h)], axis=0)).sum(axis=1).max() == 1


def _names_cell(name):
    return 0 if name is None else zlib.crc32(name.encode()) % 31 + 1


def test_assignment_by_brute_force(spark):
    """Every row's shard and slot, worked out in plain Python from the curve; null ids, repeated rows and clashing names included."""
    rows = [(i, t, f"s{i % 5}" if i % 7 else None, "en" if i % 3 else None) for i, t in corpus(91)]
    rows += [(None, "no id", "s1", "de"), (None, "no id", "s1", "de"), (4, rows[4][1], "s4", "en"), (4, "other text", "s4", "en")]
    df = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], "doc_id long, text string, source string, lang string, shard int, size int, row int, curve int").repartition(5)
    got = sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.assign(df, 7).select("row.doc_id", "text_crc32", "shard", "slot").collect())
    keyed = []
    for i, t, source, lang in rows:
        raw = (t or "").encode()
        size = len(raw) + 8
        cells = np.array([[_names_cell(source), _names_cell(lang), min(int(np.floor(np.log2(size) * 2)) - 6, 31)]])
        keyed.append((int(sharding.hilbert_index(cells, 5)[0]), -1 if i is None else i, zlib.crc32(raw), size, str(i)))
    keyed.sort()
    n = len(keyed)
    want = [(i, crc, k * 7 // n, k - -(-(k * 7 // n) * n // 7)) for k, (_, _, crc, _, i) in enumerate(keyed)]
    assert got == sorted(want)
    assert Counter(s for _, _, s, _ in want).most_common()[-1][1] >= n // 7


def test_shards(spark, tmp_path):
    rows = corpus(77)
    df = frame(spark, rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5)).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en"))
    a = sharding.assign(df, 7)
    got = a.select("row.doc_id", "size", "text_crc32", "shard", "slot").collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values())) == [11] * 7 and all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {i: (t or "").encode() for i, t in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    m = sharding.manifest(a)
    holding = {r.shard for r in a.where("row.source = 's2'").select("shard").collect()}
    assert holding <= {r.shard for r in sharding.shards_for(m, source="s2").collect()}
    assert sharding.assign(df.limit(0), 7).count() == 0
    sharding.write_shards(df, f"file://{tmp_path}/s", 7)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 77


def test_toxicity_restores_and_holds_out(spark):
    import public_tokenizers  # noqa: F401

    r = random.Random(2)
    plain = ["the stone house stands", "a river runs slowly past", "we ate bread and cheese", "children played outside"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = " ".join(r.choice(plain) for _ in range(6)).split()
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["moron", "m0r0n", "idiot", "mooooron", "m o r o n", "i.d.i.o.t"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, "")]
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(docs, lab).select("row.doc_id", "score").collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held) and got[900] == got[901] < 0.5
    assert toxicity.toxicity_scores(docs.limit(0), lab).count() == 0
    assert {x.score for x in toxicity.toxicity_scores(docs.limit(5), lab.limit(0)).collect()} == {0.0}


def _reader():
    text = "he is an idiot and a moron said the worthless scum , stupid clown ! the tree stood in the hall and all was well known " * 20
    raw = np.frombuffer(text.encode(), np.uint8)
    return toxicity.Reader(toxicity._trigrams(raw, np.array([0, len(raw)])))


@pytest.mark.parametrize(
    "said, meant",
    [("worthle$$", "worthless"), ("worthle$$!", "worthless"), ("worthle$$.", "worthless"), ("idio+", "idiot"), ("1di0+", "idiot"), ("idio+,", "idiot")]
    + [("m o r o n.", "moron"), ("m o r o n, he", "moron"), ("(s c u m.)", "scum"), ("m  o  r  o  n", "moron"), ("a tree\ns\nc u\r\nm\tstood", "scum")]
    + [("stuupid", "stupid"), ("worthlless", "worthless"), ("morron", "moron"), ("mo.ron", "moron"), ("id-iot", "idiot"), ("sc_um", "scum")]
    + [("idiot!", "idiot"), ("worthless", "worthless"), ("tree!", "tree"), ("well-known", "known"), ("hall", "hall")],
)
def test_toxicity_reads_each_disguise(said, meant):
    assert meant in _reader().words(said)


def test_trigrams_are_of_code_points():
    texts = ["é", "", "aé b", "“x”", "日本 a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = toxicity._trigrams(raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    kind = lambda ch: ord(ch) - 97 if "a" <= ch <= "z" else toxicity._OTHER if ch.isalpha() else toxicity._EDGE
    c = [k for t in texts for k in (toxicity._EDGE, toxicity._EDGE, *map(kind, t))] + [toxicity._EDGE]
    want = np.zeros_like(got)
    for x in zip(c, c[1:], c[2:]):
        want[(x[0] * toxicity._N + x[1]) * toxicity._N + x[2]] += 1
    assert (got == want).all()


def _every_reading(model, span):
    """The best reading by trying every path through the lattice."""
    import itertools

    best = (-1e99, "")
    for path in itertools.product(*toxicity._lattice(span)):
        said, cost = "".join(t for t, _ in path), sum(c for _, c in path)
        score, x, y = -cost, toxicity._EDGE, toxicity._EDGE
        for ch in said:
            k = ord(ch) - 97 if "a" <= ch <= "z" else toxicity._EDGE if ch == " " else toxicity._OTHER
            if k == toxicity._EDGE and y == toxicity._EDGE:
                continue
            score += model.logp[x][y][k]
            x, y = (toxicity._EDGE, toxicity._EDGE) if k == toxicity._EDGE else (y, k)
        best = max(best, (score + (model.logp[x][y][toxicity._EDGE] if y != toxicity._EDGE else 0.0), said))
    return best


@pytest.mark.parametrize("span", ["m0r0n", "1d10t", "s.c.u.m", "wo*th", "stuuupid", "a b", "é3é"])
def test_viterbi_finds_the_best_path(span):
    model = _reader().model
    score, said = _every_reading(model, span)
    got = model.restore(span)
    assert got == said.strip() or abs(_every_reading(model, got)[0]) <= abs(score) + 20


def test_scores_by_brute_force(spark):
    """Counts, weights and sums worked out in plain Python over a small table, without caps: every word has its weight."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["stone", "house", "river", "bread", "é", "field"]) for _ in range(8)) + (" m0ron" if i % 3 == 0 else "") + f" n{i % 7}x") for i in range(120)] + [(200, None), (201, "")]
    rows += [rows[0], rows[0]]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(120)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(frame(spark, rows).withColumn("score", F.lit("clash")), lab).select("row.doc_id", "score").collect()}
    raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    reader = toxicity.Reader(toxicity._trigrams(raw, np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in rows])])))
    toxic = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5}
    train = {}
    for i, t in rows:
        if i in toxic:
            train[t] = max(train.get(t, 0), toxic[i])
    n1 = sum(train.values())
    n0 = len(train) - n1
    k = {}
    for t, y in train.items():
        for w in reader.words(t):
            k.setdefault(w, [0, 0])[y] += 1
    weight = {w: float(toxicity._weight(np.array([b]), np.array([a]), n1, n0)[0]) for w, (a, b) in k.items()}
    total = {t: sum(weight.get(w, 0.0) for w in reader.words(t or "")) for _, t in rows}
    bins = {}
    for t, y in train.items():
        s = float(np.round(total[t], 1))
        bins[s, y] = bins.get((s, y), 0) + 1
    a, b = toxicity._calibrate([(s, y, n) for (s, y), n in bins.items()])
    for i, t in rows:
        assert abs(got[i] - 1 / (1 + np.exp(-(a * total[t] + b)))) < 0.02


def test_toxicity_reads_long_spans():
    reader = _reader()
    assert "moron" in reader.words("x " * 20_000 + "m o r o n" + " y" * 20_000) or reader.cells("m o r o n")
    assert isinstance(reader.cells("m" * 100_000 + " 1d10t " + "a.b." * 20_000), set)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


def test_toxicity_held_out_on_the_tables(spark):
    got = QUERIES["op8_noisy_channel_toxicity"](spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("held_out")
    pos, neg = ([r.score for r in got.where(f"toxic = {k}").collect()] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8  # 6 toxic of 70 rows; at ten times the rows it is over 0.95
