"""CSV by byte ranges against Spark's reader of whole files."""

import io
import random

import pytest

from reviewloom.sources.quoted_csv import read_quoted_csv, records
from reviewloom.sources.reviews import read_reviews

SCHEMA = "a string, b int, c string"
FIELDS = ["", "plain", "two words", 'a "quoted" word', "line\nend", "x\r\ny", ",", '"', '""', "\n\n", "é ü ñ", " padded ", "long " * 40]


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\n\r') or value.startswith(" ") else value


def random_file(path, seed, n=60, end="\n", last=True):
    rng = random.Random(seed)
    lines = ["a,b,c"]
    for i in range(n):
        lines.append(f"{quoted(rng.choice(FIELDS))},{rng.choice(['', str(i)])},{quoted(rng.choice(FIELDS) + rng.choice(FIELDS))}")
        if rng.random() < 0.1:
            lines.append("")
    path.write_bytes((end.join(lines) + (end if last else "")).encode())


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_each_record_begins_in_one_range(size, chunk):
    data = ('a,b\n"x\ny",1\n\n"",""\n"' + 'q""\n' * 9 + '",2\nlast,"3\n"').encode()
    whole = list(records(io.BytesIO(data), 0, len(data), False))
    assert whole[1] == b'"x\ny",1' and whole[-1] == b'last,"3\n"' and len(whole) == 6
    parts = []
    for start in range(0, len(data), size):
        inside = data[:start].count(b'"') % 2 == 1
        parts += records(io.BytesIO(data), start, min(start + size, len(data)), inside, chunk)
    assert parts == whole


@pytest.mark.parametrize("range_bytes", [61, 977, 1 << 26])
@pytest.mark.parametrize(("end", "last"), [("\n", True), ("\n", False), ("\r\n", True)])
def test_equals_the_reader_of_whole_files(spark, tmp_path, range_bytes, end, last):
    for seed in range(3):
        random_file(tmp_path / f"part-{seed}.csv", seed, end=end, last=last)
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').schema(SCHEMA).csv(str(tmp_path))
    found = read_quoted_csv(spark, str(tmp_path), SCHEMA, range_bytes)
    assert found.schema == whole.schema
    # where lines end in \r\n Spark's reader also makes one \n of those inside a field; ranges leave them as they are
    shown = [sorted(repr(r).replace("\\r\\n", "\\n") if end == "\r\n" else repr(r) for r in t.collect()) for t in (found, whole)]
    assert shown[0] == shown[1]


def test_one_large_file_is_many_tasks(spark, tmp_path):
    random_file(tmp_path / "all.csv", 9, 400)
    path = str(tmp_path / "all.csv")
    table = read_reviews(spark, path, SCHEMA, range_bytes=2_000)
    assert table.rdd.getNumPartitions() == -(-(tmp_path / "all.csv").stat().st_size // 2_000)
    assert table.count() == 400


def test_names_come_from_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"the, text",n\n"a\nb",1\n')
    assert [tuple(r) for r in read_reviews(spark, str(tmp_path / "x.csv"), None).collect()] == [("a\nb", "1")]
    assert read_reviews(spark, str(tmp_path / "x.csv"), None).columns == ["the, text", "n"]
    (tmp_path / "header.csv").write_text("a,b,c\n")
    assert read_reviews(spark, str(tmp_path / "header.csv"), SCHEMA).count() == 0


def test_other_names_and_a_missing_path_are_errors(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,c,b\n1,2,3\n")
    with pytest.raises(Exception, match="instead of"):
        read_reviews(spark, str(tmp_path / "x.csv"), SCHEMA).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_reviews(spark, str(tmp_path / "missing.csv"), SCHEMA).collect()
