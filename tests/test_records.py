"""Catalogue records split over tasks, against a plain reader of the whole file."""

import json
import os
import random
import tempfile

import pytest

from simsift.sources import catalogs, records

FIELDS = catalogs.CATALOG_SCHEMA.fieldNames()


def record(i, text):
    return {"COURSE CODE": f"C {i}", "COURSE TITLE": f"t{i}", "DESCRIPTION": text}


TEXTS = ["plain", "a } b", "a }, {\"x\": 1} b", "é \\ \" }{ }", "", None, "]}, {", "{}", "\n}\n{", "x" * 5000, "}" * 300]


def files(root):
    """Files with faults: {name: (content, good codes, pieces of every rejected record)}."""
    rng = random.Random(3)
    rows = [record(i, TEXTS[i % len(TEXTS)]) for i in range(400)]
    good = json.dumps(rows, ensure_ascii=False)
    out = {"whole": (good, [r["COURSE CODE"] for r in rows], [])}
    out["pretty"] = (json.dumps(rows, indent=2), [r["COURSE CODE"] for r in rows], [])
    kept, parts, bad = [], [], []
    for r in rows:
        text = json.dumps(r)
        if rng.random() < 0.2:
            fault = rng.choice(["cut", "quote", "key", "nan"])
            text = {"cut": text[:-2], "quote": text[:-2] + "}", "key": text.replace('"COURSE TITLE"', "TITLE"),
                    "nan": text[:-1] + ', "n": NaN}'}[fault]
            bad.append(r["COURSE CODE"])
        else:
            kept.append(r["COURSE CODE"])
        parts.append(text)
    out["faults"] = ("[" + ",\n".join(parts) + "]", kept, bad)
    out["ended"] = (json.dumps(rows[:5])[:-2], [f"C {i}" for i in range(4)], ["C 4"])
    out["stray"] = ("[" + json.dumps(rows[0]) + " junk, " + json.dumps(rows[1]) + "]", ["C 0", "C 1"], ["junk"])
    out["empty"] = ("", [], [])
    out["none"] = ("[]", [], [])
    out["lines"] = ("\n".join(json.dumps(r) for r in rows[:1]), ["C 0"], [])
    for name, (content, _, _) in out.items():
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/2020-2021.json", "w", encoding="utf8") as f:
            f.write(content)
    return out, rows


@pytest.mark.parametrize("block", [700, 20_000, 128 << 20])
def test_records_whatever_the_blocks(spark, block):
    root = tempfile.mkdtemp(prefix="records-")
    made, rows = files(root)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read, rejected = catalogs.read_catalog_records(spark, root)
        got, bad = read.collect(), rejected.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    texts = {r["COURSE CODE"]: r["DESCRIPTION"] for r in rows}
    for name, (content, codes, faults) in made.items():
        mine = [r for r in got if r.INSTITUTION == name]
        assert sorted(r["COURSE CODE"] for r in mine) == sorted(codes), name
        assert all(r["DESCRIPTION"] == texts[r["COURSE CODE"]] and r.YEAR == "2020" for r in mine)
        pieces = sorted((r for r in bad if r.INSTITUTION == name), key=lambda r: r.position)
        raw = content.encode()
        assert all(raw[r.position:r.position + r.length] == bytes(r.text) for r in pieces), name
        said = b" | ".join(bytes(r.text) for r in pieces).decode()
        assert all(f'"{c}"' in said or c in said for c in faults), name
        assert not faults or len(pieces) >= len(faults)
        assert faults or not pieces, name
        if name in ("ended", "faults"):
            assert not any(f'"{c}"' in said for c in codes)
    assert [r.reason for r in bad if r.INSTITUTION == "ended"] == ["truncated"]


def test_same_as_the_multiline_reader(spark):
    root = tempfile.mkdtemp(prefix="records-")
    for name in ("A", "B"):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/2020-2021.json", "w") as f:
            json.dump([record(i, t) for i, t in enumerate(TEXTS)] + [{}, {"COURSE CODE": 7, "other": [1, 2]}], f)
    rows, rejected = catalogs.read_catalog_records(spark, root)
    assert sorted(map(str, rows.collect())) == sorted(
        str(r) for r in catalogs.read_catalogs(spark, root).collect() if r["COURSE CODE"] is not None)
    assert [bytes(r.text) for r in rejected.collect()] == [b"{}", b"{}"]


def test_long_records_are_rejected_not_lost(spark):
    root = tempfile.mkdtemp(prefix="records-")
    content = json.dumps([record(1, "a"), record(2, "b } " * 2000), record(3, "c")])
    with open(f"{root}/2020-2021.json", "w") as f:
        f.write(content)
    rows, rejected = records.read_records(spark, root, catalogs.CATALOG_SCHEMA, max_record=1000)
    assert sorted(r["COURSE CODE"] for r in rows.collect()) == ["C 1", "C 3"]
    pieces = sorted(rejected.collect(), key=lambda r: r.position)
    assert content.encode()[pieces[0].position:].startswith(b'{"COURSE CODE": "C 2"')
    assert b"".join(bytes(r.text) for r in pieces).count(b"b }") == 2000
