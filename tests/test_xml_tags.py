"""Tags of XML files in splits of any size against a whole parse."""

import random
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

import pytest

from recolith.sources import tables, xml_tags


def document(rng, n):
    out = ["<?xml version='1.0'?>\n<!DOCTYPE R>\n<R>"]
    depth = 0
    for i in range(n):
        k = rng.randrange(9)
        value = "".join(rng.choice(['a', ">", "'", '"', "<", "&", "é", " Id='9'", "/>", "-->", " "]) for _ in range(rng.randint(0, 30)))
        if k == 0:
            out.append("<!-- <NODE Id='no' ParentId=\"x\"> " + rng.choice(["", ">", "]]>", "' \" "]) + "-->")
        elif k == 1:
            out.append("<![CDATA[ <NODE Id='no'> \" --> ]]>" + rng.choice(["", "text > here"]))
        elif k == 2:
            out.append("<?do <NODE Id='no'> ?>")
        elif k == 3 and depth:
            out.append("</NODE>")
            depth -= 1
        elif k == 4:
            out.append(f"<NODEX Id='no' a={quoteattr(value)}/>")
        else:
            close, mark, key = rng.random() < 0.6, rng.choice("\"'"), "Id" if k < 8 else "Key"
            name = quoteattr(value).replace("&gt;", ">")
            out.append(f"<NODE{rng.choice([' ', '  ', chr(10)])}Name={name} {key} = {mark}i{i}&amp;&#65;&#x42;{mark} ParentId=\"p\" {'/' if close else ''}>")
            depth += not close
    return "".join(out) + "</NODE>" * depth + "</R>\n"


def expected(text):
    return sorted((e.get("Id"), e.get("ParentId")) for e in ET.fromstring(text).iter("NODE") if e.get("Id") is not None)


@pytest.mark.parametrize("size", ["40", "333", "2000", "10m"])
def test_any_split_gives_the_same_rows(spark, tmp_path, size):
    rng = random.Random(7)
    texts = [document(rng, 120) for _ in range(2)] + ["<R/>", "<R><NODE Id='" + "x>" * 3000 + "' ParentId='p'/><NODE Id='z'/></R>", ""]
    for i, x in enumerate(texts):
        (tmp_path / f"{i}.xml").write_text(x)
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        found = tables.playlist_nodes(spark, str(tmp_path))
        if size == "40":
            assert spark.read.text(str(tmp_path), lineSep=">").rdd.getNumPartitions() > 4
        got = sorted((r["node_id"], r["parent_id"]) for r in found.collect())
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert got == sorted(x for t in texts if t for x in expected(t)) and len(got) > 60


def test_steps():
    assert xml_tags.step("<!--", xml_tags.PLAIN) == (xml_tags.COMMENT, -1)
    assert xml_tags.step("<!-- a --", xml_tags.PLAIN) == (xml_tags.PLAIN, -1)
    assert xml_tags.step("<a b='", xml_tags.PLAIN) == (xml_tags.SINGLE, 0)
    assert xml_tags.step("' c=\"d\"", xml_tags.SINGLE) == (xml_tags.PLAIN, -1)
    assert xml_tags.attributes("NODE Id='&lt;&amp;amp;' b = \"'\"") == {"Id": "<&amp;", "b": "'"}
