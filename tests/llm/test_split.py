import random

from tidemark.llm.split import INSIDE, LEVELS, _strongest, boundary_of, pieces_of, split_chunks, split_oversized


def check(text, limit, overlap):
    name, cut, pieces = pieces_of(text, limit, overlap)
    order = ["", *(n for n, _ in LEVELS), INSIDE]
    assert order.index(cut) >= order.index(name)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, _) in zip(pieces, pieces[1:], strict=False):
        assert s2 == e - overlap and s2 >= 0
    assert all(0 < e - s <= limit for s, e in pieces)
    return name, pieces


def test_round_trip_on_random_texts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["word", "x" * rng.randrange(1, 60), " ", " ", ". ", "! ", "\n", "\n \t\n", "\r\n", "é🙂"]) for _ in range(rng.randrange(1, 200)))
        limit = rng.randrange(30, 200)
        check(text, limit, rng.randrange(0, limit // 2))


def cascade(text, limit):
    """The definition: each kind of cut only cuts the parts that are still too long."""
    long = [text]
    for name, rx in LEVELS:
        long = [p for t in long for p in rx.split(t) if len(p) > limit]
        if not long:
            return name
    return INSIDE


def test_boundary_is_that_of_the_cuts_and_agrees_with_the_definition():
    rng = random.Random(5)
    for n in range(600):
        parts = [rng.choice(["word", "x" * rng.randrange(1, 90), " ", " ", ". ", "? \n", "\n", "\n \t\n", "\r\n\r\n"]) for _ in range(rng.randrange(1, 200))]
        text, limit = "".join(parts), rng.randrange(30, 200)
        if len(text) > limit:
            name, made = _strongest(text, limit, None, len(LEVELS))
            assert name == boundary_of(text, limit) == cascade(text, limit)
            ends = [s for s, _, _ in made] + [len(text)]
            assert all(e - s <= limit for s, e in zip([0] + [e for _, e, _ in made], ends, strict=True))


def test_pieces_are_few_and_many_are_possible():
    for k in (3, 40, 400):  # no bound on the number of pieces
        name, cut, pieces = pieces_of(" ".join(["y" * 90] * k), 100, 0)
        assert name == cut == "word" and len(pieces) == k
    even = " ".join(["word"] * 1000)
    sizes = [e - s for s, e in pieces_of(even, 1000, 0)[2]]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 10


def test_boundaries():
    p = "a" * 90
    assert boundary_of(f"{p}\n\t \n{p}", 100) == "paragraph"
    assert boundary_of(f"{p}\n\n{p}\r\n{p}", 100) == "line"
    assert boundary_of(f"{p}. {p}", 100) == "sentence"
    assert boundary_of(f"{p} {p}", 100) == "word"
    assert boundary_of("a" * 300, 100) == "inside_word"
    assert boundary_of(f"{'a' * 100}\n\n{'b' * 100}", 100) == "paragraph" and boundary_of(f"{'a' * 101}\n\nb", 100) == "inside_word"


def test_cuts_snap_to_paragraphs():
    text = "\n\n".join("s" * 80 for _ in range(10))
    _, pieces = check(text, 300, 40)
    assert all(text[:e].endswith("\n\n") for _, e in pieces[:-1])


def test_tables(spark):
    rows = [("a", "d", 0, "x" * 5, "l", None), ("b", "d", 1, "w " * 400, "l", None), ("c", "d", 5, "y" * 700, None, None), ("e", None, None, "z" * 400, "l", None), ("n", "d", 2, None, "l", None), ("0", "d", 3, "", "l", None)]
    df = spark.createDataFrame(rows, "id string, document_id string, chunk_index int, content string, section_label string, created_at timestamp")
    got = split_chunks(df, limit=300, overlap=30).orderBy("chunk_id", "piece").collect()
    index = {}
    for r in got:
        index.setdefault(r.chunk_id, []).append(r.chunk_index)
    assert index == {"b": [1, 2, 3], "c": [6, 7, 8], "e": [0, 1]}
    assert split_oversized(df.limit(0), key="id", text="content").count() == 0
    assert split_oversized(df.union(df), key="id", text="content", limit=300, overlap=30).count() == 6
