"""Size-bounded chunks and parts of books against plain walks."""

import random
import time

import pytest

from lectern.operators import estimate, segment

BLANK = b" \t\n\r\x0b\x0c"


def slow_split(text, most, words=True):
    """Cuts the rest of the text again and again, trying one place after the other."""
    data, out = text.strip(segment._TRIM).encode(), []
    inside = lambda d, at: d.rfind(b"<", 0, at) > d.rfind(b">", 0, at)
    whole = lambda d, at: at >= len(d) or d[at] & 0xC0 != 0x80
    while len(data) > most:
        near = range(most, most // 2, -1)
        places = [at for at in near if data[at - 1] in b".!?" and data[at] in BLANK and not inside(data, at)]
        places += [at for at in near if words and data[at - 1] in BLANK and not inside(data, at)]
        places += [at for at in range(most, 0, -1) if whole(data, at) and not inside(data, at)]
        places += [at for at in range(most, 0, -1) if whole(data, at)]
        places += [at for at in range(1, len(data) + 1) if whole(data, at)]
        out.append(data[: places[0]].decode().strip(segment._TRIM))
        data = data[places[0] :]
    return [x for x in (*out, data.decode().strip(segment._TRIM)) if x]


@pytest.mark.parametrize("words", [True, False])
def test_cuts_equal_a_plain_walk(words):
    rng = random.Random(words)
    bits = ["Word", "é", "ende.", "Was? ", " ", "\n", '<break time="500ms"/>', "<", ">", "<<b>", "x" * 30, "日本", "! ", ".", "<" + "long " * 12 + ">"]
    for _ in range(1500):
        text, most = "".join(rng.choices(bits, k=rng.randrange(60))), rng.randrange(3, 90)
        got = segment.split_by_size(text, most, words)
        assert got == slow_split(text, most, words), (text, most)
        assert "".join("".join(got).split()) == "".join(text.split())


def test_markup_stays_whole():
    text = 'Sentence 1.<break time="500ms"/>Sentence 2.<break time="500ms"/>Sentence 3 is longer than those.'
    for most in range(25, 60):
        for piece in segment.split_by_size(text, most):
            assert len(piece.encode()) <= most and piece.count("<break") == piece.count("/>")


def test_long_texts_take_linear_time():
    times = []
    for n in (40_000, 400_000):
        began = time.time()
        assert len(segment.split_by_size("Some words are here. <b x='1'>" * n, 900)) > n / 40
        times.append(time.time() - began)
    assert times[1] < 25 * times[0] + 1


def slow_parts(rows, limit):
    out, part, filled, book = [], 0, 0, object()
    for own, no, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if own != book:
            book, part, filled = own, 1, size
        elif filled + size > limit:
            part, filled = part + 1, size
        else:
            filled += size
        out.append((own, no, size, part))
    return out


@pytest.mark.parametrize(("span", "mb", "lengths"), [(16, 1, (0, 10, 50, 100, 900, 4000)), (64, 30, (0, 1, 50, 900)), (7, 15, (100,)), (50, 500, (3, 9, 4000)), (4096, 60, (10, 900))])
def test_parts_equal_a_plain_walk(spark, span, mb, lengths):
    """Books in one span and in many, chapters over the limit, repeated chapter numbers, no book number."""
    rng = random.Random(span)
    rows = [(b, i // (3 if b == 3 else 1), float(rng.choice(lengths))) for b, n in ((None, 5), (1, 2500), (2, 3), (3, 700), (4, 1)) for i in range(n)]
    rng.shuffle(rows)
    got = estimate.pack_parts(spark.createDataFrame(rows, "book_id long, chapter_no long, seconds double"), mb, 128, span=span).collect()
    want = slow_parts([(b, i, int(s * 16000 * 1.05)) for b, i, s in rows], mb << 20)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.book_id, r.chapter_no, r.size, r.part_no) for r in got), key=key) == sorted(want, key=key)


def test_no_chapters_no_parts(spark):
    df = spark.createDataFrame([], "book_id long, chapter_no long, seconds double")
    assert estimate.pack_parts(df, 10).count() == 0


def test_lists_are_cut_and_merged_by_slices(spark, monkeypatch):
    """A task holds few texts as Python objects, whatever a batch brings; results are those of one text at a time."""
    import pyarrow as pa

    held = []
    lists = pa.array([None if i % 10 == 3 else [f"w{i} " * 30, "b."] for i in range(1000)], pa.list_(pa.string()))
    sizes = pa.array([20 + i % 50 for i in range(1000)])
    plain, chunked = pa.array, []

    def counted(rows, *kind):
        chunked.append(len(rows))
        return plain(rows, *kind)

    monkeypatch.setattr(segment.pa, "array", counted)
    got = segment._by_slices(lambda x, n: held.append(n) or [y for p in x for y in segment.split_by_size(p, n)], lists, sizes)
    monkeypatch.undo()
    assert max(chunked) <= segment.SLICE and len(held) == 900
    assert got.to_pylist() == [None if x is None else [y for p in x for y in segment.split_by_size(p, n)] for x, n in zip(lists.to_pylist(), sizes.to_pylist(), strict=True)]
    df = spark.createDataFrame([(i, f"one two {i}. " * (i % 40) if i % 7 else None) for i in range(500)], "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.chunks for r in segment.merge_lists(segment.chunk_lists(df, "sentence", 60), 30).collect()}
    for i in range(500):
        text = f"one two {i}. " * (i % 40)
        cut = [y for p in text.split(". ") if p for y in segment.split_by_size(p + ".", 60)]
        assert whole[i] == (segment.merged_small(cut, 30, 60) if i % 7 else None)
