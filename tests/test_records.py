"""Delimited files in blocks: whatever the block size, the same records as reading a file whole."""

import csv
import io
import random

import pytest

from ledgerloom.sources import files, records


def _texts():
    rng = random.Random(7)
    cells = ["", "a", "two words", "5\" pipe", "comma, inside", "line\nbreak", 'say ""so""', "数据", "\r\nend", " ", "x" * 40, '"', "\n\n\n", "é,é"]
    out = []
    for _ in range(12):
        rows = [[rng.choice(cells) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(0, 25))]
        to = io.StringIO(newline="")
        writer = csv.writer(to, lineterminator=rng.choice(["\n", "\r\n"]))
        for r in rows:
            writer.writerow(r) if rng.random() < 0.9 else to.write("\n")
        text = to.getvalue()
        out.append(text.rstrip("\r\n") if rng.random() < 0.3 else text)
    return [*out, "", "\n", "no end", '"open\nto the end', 'a,5" x\nb,"q"" "\n', '"a"b,"c\n"\n,\n']


def _whole(text):
    return list(csv.reader(io.StringIO(text, newline="")))


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_blocks_read_what_whole_files_hold(spark, tmp_path, size):
    texts = _texts()
    for k, t in enumerate(texts):
        (tmp_path / "book").mkdir(exist_ok=True)
        (tmp_path / "book" / f"{k:02}.csv").write_bytes(t.encode())
    got = records.read_cells(spark, str(tmp_path), every=True, block_bytes=size).collect()
    sheets = {f"{k:02}": _whole(t) for k, t in enumerate(texts)}
    want = [(s, k + 1, row) for s, rows in sheets.items() for k, row in enumerate(rows)]
    assert sorted((r["source_sheet"], r["row_no"], r["cells"]) for r in got) == sorted(want)
    assert {r["source_file"] for r in got} == {"book"} and all(int(r["source_sheet"]) + 1 == r["sheet_ord"] for r in got)


def test_first_filled_sheet_and_parts(spark, tmp_path):
    for path, said in {"one/a/1.csv": " ,\n", "one/b/1.csv": "x,y\n\n", "one/b/2.csv": '"p\nq"\n', "one/c/1.csv": "z\n", "two/a/1.csv": ",\n", "two/b/1.csv": "\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(said)
    naming = r"([^/]+)/([^/]+)/[^/]+\.csv$"
    told = lambda **x: sorted((r["source_file"], r["source_sheet"], r["row_no"], tuple(r["cells"])) for r in records.read_cells(spark, str(tmp_path), naming=naming, **x).collect())
    assert told() == [("one", "b", 1, ("x", "y")), ("one", "b", 2, ()), ("one", "b", 3, ("p\nq",)), ("two", "a", 1, ("", ""))]
    assert told(sheet="c") == [("one", "c", 1, ("z",))]
    assert len(told(every=True)) == 7
    (tmp_path / "none").mkdir()
    assert records.read_cells(spark, str(tmp_path / "none")).count() == 0


ENCODED = {
    "utf-8": "名,金额\n甲,1\n" + "乙,2\n" * 40,
    "gbk": "名,金额\n甲,1\n" + "丙丁,2\n" * 40,
    "gb18030": "名,金额\n𠀀,1\n" + "戊,2\n" * 40,
    "latin-1": "name,fee\n\xff\x80,1\n" + "b,2\n" * 40,
}


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_encodings_hold_for_whole_files(spark, tmp_path, size):
    for name, said in ENCODED.items():
        (tmp_path / f"{name}.csv").write_bytes(said.encode(name))
    # One byte, far behind, rules an encoding out.
    (tmp_path / "late.csv").write_bytes(("name,fee\n" + "a,1\n" * 60).encode() + b"\xff,2\n")
    (tmp_path / "bom.csv").write_bytes("名,金额\n己,3\n".encode("utf-8-sig"))
    paths = sorted(str(p) for p in tmp_path.iterdir())
    probed = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["names"]) for r in files.probe_files(spark, paths, size).collect()}
    assert probed == {f"{e}.csv": (e, ENCODED[e].split("\n")[0].split(",")) for e in ENCODED} | {"late.csv": ("latin-1", ["name", "fee"]), "bom.csv": ("utf-8", ["名", "金额"])}
    rows = files.read_settlement_csv(spark, paths, size).collect()
    got = sorted((r["source_file"], r["名"] or r["name"], r["金额"] or r["fee"]) for r in rows)
    want = [(f"{e}.csv", *line.split(",")) for e in ENCODED for line in ENCODED[e].split("\n")[1:] if line]
    assert got == sorted([*want, *[("late.csv", "a", "1")] * 60, ("late.csv", "ÿ", "2"), ("bom.csv", "己", "3")])


def test_rows_of_named_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Order Id,"Note, long",order id\n1,"two\nlines",9\n\n2\n3,x,y,z\n')
    got = [(r["order_id"], r["note,_long"]) for r in files.read_settlement_csv(spark, str(tmp_path), 4).orderBy("order_id").collect()]
    assert got == [("1", "two\nlines"), ("2", ""), ("3", "x")]


def test_long_records_pass_block_ends(spark, tmp_path):
    body = ("y" * 70 + '\n""') * 60_000  # 4 MB within one pair of quotes
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "s.csv").write_text(f'1,"{body}",z\n2,b,c\n')
    got = sorted((r["row_no"], [len(c) for c in r["cells"]]) for r in records.read_cells(spark, str(tmp_path), block_bytes=100_000).collect())
    assert got == [(1, [1, 72 * 60_000, 1]), (2, [1, 1, 1])]


def test_a_block_is_never_held_as_records(tmp_path):
    import tracemalloc

    path = tmp_path / "a.csv"
    path.write_text('1,"2,50",数据,,x\n' * 200_000, encoding="utf-8")
    size = path.stat().st_size
    raw = path.read_bytes()
    tracemalloc.start()
    n = sum(len(r) == 5 for r in records.block_records(str(path), 0, size, False, "utf-8"))
    ended = records.records_ended(raw, False, True)
    fits = [records._readable(raw, e) for e in ("utf-8", "gb18030")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == ended[0] == 200_000 and fits[0]
    assert peak < 2 * size + (8 << 20)
