from __future__ import annotations

import zipfile

import numpy as np

from attestry.sources import chunks, readers
from tests.conftest import rows


def u16(text, start, end):
    return text.encode("utf-16-be")[2 * start : 2 * end].decode("utf-16-be")


def test_lines_keep_offsets_over_breaks_and_emoji(spark):
    texts = {"a": "first\nsecond\n", "b": "é😀x\r\n\r\ny\rz\n \nlast", "c": "", "d": None, "e": "\n\n"}
    got = readers.lines(spark.createDataFrame(list(texts.items()), "source_version_id string, text string")).collect()
    assert sorted((r.source_version_id, r.ord, r.text) for r in got) == [("a", 1, "first"), ("a", 2, "second"), ("b", 1, "é😀x"), ("b", 3, "y"), ("b", 4, "z"), ("b", 6, "last")]
    assert all(u16(texts[r.source_version_id], r.start, r.end) == r.text for r in got)


def test_work_marks(spark):
    text = "title\n*** START OF THE BOOK ***\nbody\nmore\n*** END OF THE BOOK ***\nlicence"
    s = spark.createDataFrame([("a", text), ("b", "no marks\nhere")], "source_version_id string, text string")
    got = readers.marked(readers.lines(s), s)
    assert [r.segment for r in got.where("source_version_id = 'a'").orderBy("ord").collect()] == ["front-matter", "front-matter", "work", "work", "back-matter", "back-matter"]
    assert {r.segment for r in got.where("source_version_id = 'b'").collect()} == {"work"}


def test_html_paragraphs(spark):
    page = "<head><title>x</title></head><script>bad()</script><nav>menu</nav><p>One &amp; <b>two</b></p><div>caf&#233; &nbsp; x</div><!-- no --><p> </p>a<br/>b &amp;lt;"
    got = readers.paragraphs(spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string"), "id", "html")
    assert [r.text for r in got.orderBy("pos").collect()] == ["One & two", "café x", "a", "b &lt;"]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nx,"a, ""b""\nc"\ny,\n')
    assert rows(readers.csv_rows(spark, str(tmp_path / "a.csv")), "row", "text") == [(2, 'name: x; note: a, "b"\nc'), (3, "name: y; note: ")]
    (tmp_path / "b.tsv").write_text('h1\th2\n"q\tv\n')
    assert rows(readers.csv_rows(spark, str(tmp_path / "b.tsv"), sep="\t", quoted=False), "text") == [('h1: "q; h2: v',)]
    j = readers.json_lines(spark.createDataFrame([("ok", '{\n"a": 1}'), ("no", "{")], "source_version_id string, text string"))
    assert rows(j, "source_version_id", "valid", "ord") == [("no", False, None), ("ok", True, 1), ("ok", True, 2)]


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n\ntwo")
    (tmp_path / "l.txt").write_bytes(b"caf\xe9 x")
    (tmp_path / "j.json").write_text("{bad")
    (tmp_path / "z.bin").write_bytes(b"\x00\x01")
    (tmp_path / "broken.docx").write_bytes(b"nothing")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:p/></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "e.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><head><title>t</title></head><body><p>A one</p><p>A two</p></body></html>")
        z.writestr("o/b.xhtml", "<html><body><p>B</p></body></html>")
    regions, coverage = readers.files(spark, str(tmp_path))
    assert sorted(r.text for r in regions.collect()) == ["A one", "A two", "B", "Hello there", "caf\ufffd x", "one", "two"]
    assert regions.select("region_id").distinct().count() == 7
    assert sorted(r.state for r in coverage.collect()) == ["partial", "ready", "ready", "ready", "ready", "unreadable", "unreadable"]
    assert [r.text for r in regions.where("kind = 'epub-chapter'").orderBy("ord").collect()] == ["A one", "A two", "B"]


def test_chunks(spark):
    r = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate([4, 4, 4, 20, 1, 9])] + [("t", 0, None), ("t", 1, "y")], "source_version_id string, ord int, text string")
    got = chunks.grouped(r, most_chars=10)
    assert [x.chunk for x in got.where("source_version_id = 's'").orderBy("ord").collect()] == [0, 0, 1, 2, 3, 3]
    assert {x.chunk for x in chunks.grouped(r, 10, most_rows=1).where("source_version_id = 't'").collect()} == {0, 1}
    many = spark.createDataFrame([("s", i, "x" * (i % 7)) for i in range(500)] + [(None, 1, "a"), (None, 2, "bc")], "source_version_id string, ord int, text string").selectExpr("*", "'z' as chunk_", "1 as n")
    want, chunk, chars = {}, 0, 0
    for i in range(500):
        if i and chars + i % 7 > 20:
            chunk, chars = chunk + 1, 0
        chars += i % 7
        want[i] = chunk
    got = chunks.grouped(many, most_chars=20)
    assert {x.ord: x.chunk for x in got.where("source_version_id = 's'").collect()} == want and got.where("source_version_id is null").count() == 2
    a, state = chunks.numbers(np.array([4, 4, 4]), 10, None, (0, 0, 0))
    b, _ = chunks.numbers(np.array([20, 1, 9]), 10, None, state)
    assert [*a, *b] == [0, 0, 1, 2, 3, 3]


def test_cutting_long_texts(spark):
    text = "  para one word\n\n" + "lorem " * 700 + "\n \n\nend\n\n" + "y" * 3000 + "\n"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n\n "), (5, "é one")], "id long, text string").selectExpr("*", "0 as part", "1 as start")
    got = chunks.cut_rows(d, "id").orderBy("id", "part").collect()
    mine = [r for r in got if r.id == 1]
    assert all(0 < r.end - r.start <= 1400 and text[r.start : r.end] == r.text == r.text.strip() for r in mine) and [r.part for r in mine] == list(range(len(mine)))
    assert "".join("".join(r.text.split()) for r in mine) == "".join(text.split())
    assert [len(r.text) for r in mine] == [13, 1397, 1397, 1397, 5, 3, 1400, 1400, 200] and {r.id for r in got} == {1, 5}
