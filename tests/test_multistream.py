import bz2
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import dump, multistream

PAGE = "<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{r}<revision><text xml:space=\"preserve\">{x}</text></revision></page>\n"


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """A dump of 40 members with 7 pages each, its index, and its rows."""
    rng, top = random.Random(4), tmp_path_factory.mktemp("dump")
    data, index, rows, i = bz2.compress(b"<mediawiki>\n<siteinfo/>\n"), [], [], 0
    for _ in range(40):
        block, at = "", len(data)
        for _ in range(7):
            i += 1
            text = "".join(rng.choice("abé \n&<") for _ in range(rng.randint(0, 900)))
            turned = "" if i % 9 else '<redirect title="Page 1 &amp; é" />'
            block += PAGE.format(t=f"Page {i}: x", ns=i % 3, i=i, r=turned, x=text.replace("&", "&amp;").replace("<", "&lt;"))
            rows.append((at, i, i % 3, f"Page {i}: x", None if i % 9 else "Page 1 & é", text))
            index.append(f"{at}:{i}:Page {i}: x")
        data += bz2.compress(block.encode())
    data += bz2.compress(b"</mediawiki>")
    (top / "d.xml.bz2").write_bytes(data)
    (top / "d-index.txt.bz2").write_bytes(bz2.compress("\n".join(index).encode()))
    return f"file://{top}/d.xml.bz2", f"file://{top}/d-index.txt.bz2", rows


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("parts", [1, 2, 7, 64, 1000])
def test_one_file_gives_as_many_tasks_as_asked(spark, made, parts):
    pages = multistream.pages(spark, made[0], partitions=parts)
    assert pages.rdd.getNumPartitions() == parts
    assert got(pages) == made[2]


def test_a_folder_and_the_xml_reader_give_the_same(spark, made):
    folder = made[0].rpartition("/")[0]
    rows = multistream.pages(spark, folder, partitions=5).drop("block")
    assert got(rows) == [r[1:] for r in made[2]]
    trimmed = rows.withColumn("text", F.trim("text", F.lit(" \n")))  # the XML reader takes space off the ends of a text
    assert got(trimmed) == got(dump.pages(spark, made[0]))


@pytest.mark.parametrize("n", [0, 1, 3, 40, 99])
def test_first_blocks_leave_later_ranges_unplanned(spark, made, n):
    offsets = sorted({r[0] for r in made[2]})[:n]
    for index in (None, made[1]):
        reader = multistream._Reader({"path": made[0], "partitions": "16", "blocks": str(n)} | ({"index": index} if index else {}))
        ends = [p.end for p in reader.partitions()]
        assert max(ends) <= min((r[0] for r in made[2] if r[0] not in offsets), default=1 << 60)
        assert got(multistream.pages(spark, made[0], 16, n, index)) == [r for r in made[2] if r[0] in offsets]


def test_members_by_offset_and_pages_by_title(spark, made):
    index = dump.index(spark, made[1]).withColumn("path", F.lit(made[0]))
    some = index.where("page_id % 50 = 3").select("path", "offset")
    offsets = {r["offset"] for r in some.collect()}
    assert got(multistream.pages_at(some)) == [r for r in made[2] if r[0] in offsets]
    wanted = spark.createDataFrame([("Page 5: x",), ("Page 6: x",), ("Page 200: x",), ("none",)], "title string")
    assert [r["id"] for r in multistream.looked_up(index, wanted).orderBy("id").collect()] == [5, 6, 200]


def test_one_large_member_and_marks_inside_data(spark, tmp_path):
    """A dump of a single member is read whole by the task in whose range it starts; a text that holds a member's marks is text."""
    rows = [(i, 0, f"T{i}", None, "BZh91AY&SY &" * 2000 + str(i)) for i in range(300)]
    xml = "".join(PAGE.format(t=t, ns=ns, i=i, r="", x=x.replace("&", "&amp;")) for i, ns, t, _, x in rows)
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert got(multistream.pages(spark, f"file://{tmp_path}/d.xml.bz2", 4).drop("block")) == rows


def test_a_broken_dump_is_refused(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(PAGE.format(t="a", ns=0, i=1, r="", x="x" * 5000).encode())[:-20])
    with pytest.raises(Exception, match="has no end"):
        multistream.pages(spark, f"file://{tmp_path}/d.xml.bz2").collect()
    (tmp_path / "e.xml.bz2").write_bytes(b"")
    assert multistream.pages(spark, f"file://{tmp_path}/e.xml.bz2").count() == 0


def test_what_is_written_is_read_back(spark, tmp_path):
    rows = [(i, i % 2, f"T<{i}> & \"q\"", None if i % 5 else "T<0>", f"line\r\nnext \t é {i} ]]>") for i in range(250)]
    table = spark.createDataFrame(rows, "id long, ns int, title string, redirect string, text string").repartition(3)
    index = multistream.write(table, f"file://{tmp_path}/out", 20)
    index.write.parquet(f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    assert got(multistream.pages(spark, f"file://{tmp_path}/out", 9).drop("block")) == rows
    assert index.count() == 250 and index.select("path").distinct().count() == 3
    assert got(multistream.pages_at(index.select("path", "offset")).drop("block")) == rows
