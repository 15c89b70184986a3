"""Batches of manifests against a plain loop that registers one row after the other."""

import hashlib
import random

import pytest

from clauselake.operators import registry

VERSIONS = "version_id string, logical_id string, source_hash string, source_filename string, title string, doc_number string, pipeline_status string"
ROW = {c: "" for c in registry.MANIFEST} | {"perm_tag": "p"}


def one_by_one(manifest, content, known, batch):
    """What registering the rows in their order gives: {row: (status, reason, version, logical id, relation, predecessor)}."""
    stored = [dict(zip(("version_id", "logical_id", "source_hash", "source_filename", "title", "doc_number"), k, strict=False)) for k in known]

    def read(cell):
        cell = cell.strip()
        if cell.startswith("abolish:"):
            return "abolish_only", [cell[8:].strip()]
        names = [x.strip() for x in cell.split(";") if x.strip()]
        return ("none" if not cell else "merge" if len(names) > 1 else "revise_replace"), names

    claims = [names[0] for kind, names in (read(r["supersedes"]) for r in manifest) if kind in ("revise_replace", "abolish_only")]
    out = {}
    for n, row in enumerate(manifest):
        name = row["filename"]
        if not name:
            continue
        kind, names = read(row["supersedes"])
        if kind == "revise_replace" and claims.count(names[0]) > 1:
            kind = "split_replace"
        if name not in content:
            out[n] = ("MISSING", "no such file", None, None, kind, None)
            continue
        digest = hashlib.sha256(content[name]).hexdigest()
        same = [v for v in stored if v["source_hash"] == digest]
        if same:
            out[n] = ("DUPLICATE", "same content", min(v["version_id"] for v in same), None, kind, None)
            continue
        twin = row["title"] and row["doc_number"] and any((v["title"], v["doc_number"]) == (row["title"], row["doc_number"]) for v in stored)
        reason = "format" if name.endswith(".exe") else "no permission tag" if not row["perm_tag"] else "suspected duplicate" if twin else None
        own = hashlib.sha1(f"{batch}|{name}|{digest}".encode()).hexdigest()[:26]
        prior = next((v for v in stored if kind in ("revise_replace", "abolish_only") and v["source_filename"] == names[0]), None)
        logical = prior["logical_id"] if prior and kind == "revise_replace" else "L" + own
        stored.append({"version_id": own, "logical_id": logical, "source_hash": digest, "source_filename": name, "title": row["title"], "doc_number": row["doc_number"]})
        out[n] = ("QUARANTINED" if reason else "REGISTERED", reason, own, logical, kind, prior and prior["version_id"])
    return out


def decided(spark, manifest, content, known=(), batch="b"):
    frame = spark.createDataFrame([r | {"at": n} for n, r in enumerate(manifest)]).repartition(3)
    files = spark.createDataFrame([(k, bytearray(v), "unknown" if k.endswith(".exe") else "pdf") for k, v in content.items()], "filename string, content binary, format string")
    return registry.register_batch(frame, files, spark.createDataFrame(list(known), VERSIONS), batch, order="at")


def as_rows(frame):
    return {r.row: (r.status, r.reason, r.version_id, r.logical_id, r.relation, r.supersedes_version_id) for r in frame.collect()}


def test_chains_twins_and_splits(spark):
    row = lambda name, **k: ROW | {"filename": name} | k
    manifest = [
        row("e", supersedes="y"),  # comes later: none
        row("c"), row("d", supersedes="c"), row("z", supersedes="d"), row("f", supersedes="z"),
        row("g", supersedes="h"), row("h", supersedes="g"),  # a circle: the first has no predecessor yet
        row("s1", supersedes="c2"), row("c2"), row("s2", supersedes="c2"), row("s3", supersedes="c2"),  # a split
        row("a", supersedes="abolish: f"), row("b", supersedes="a"),
        row("gone", title="t", doc_number="n"), row("t1", title="t", doc_number="n"), row("t2", title="t", doc_number="n"),
        row("dup", title="u", doc_number="m"), row("t3", title="u", doc_number="m"),
        row("o", supersedes="old"), row("p", supersedes="o"), row(""), row("c"), row("x.exe"), row("y", perm_tag=""),
    ]
    content = {r["filename"]: r["filename"].encode() for r in manifest if r["filename"] not in ("", "gone")} | {"dup": b"c"}
    known = [("v0", "l0", "0", "old", "", "", "INDEXED"), ("v1", "l1", "1", "old", "q", "q", "INDEXED")]
    want = one_by_one(manifest, content, known, "b")
    frame = decided(spark, manifest, content, known).cache()
    assert as_rows(frame) == want
    by_name = {manifest[n]["filename"]: x for n, x in sorted(want.items(), reverse=True)}
    assert by_name["c"][3] == by_name["d"][3] == by_name["f"][3] and by_name["f"][5] == by_name["z"][2]
    assert by_name["p"][3] == "l0" and by_name["t1"][0] == "REGISTERED" and by_name["t2"][1] == "suspected duplicate" and by_name["t3"][0] == "REGISTERED"
    events = {(r.filename, r.from_state, r.to_state) for r in registry.registration_events(frame, spark.createDataFrame(known, VERSIONS)).collect()}
    assert ("dup", "REGISTERED", "REGISTERED") in events and ("c", None, "REGISTERED") in events and not any(e[0] == "gone" for e in events)
    # The next batch sees what this one stored.
    stored = registry.registered(frame).select(*spark.createDataFrame([], VERSIONS).columns)
    again = spark.createDataFrame([row("n", supersedes="f") | {"at": 0}, row("m", title="t", doc_number="n") | {"at": 1}])
    files = spark.createDataFrame([("n", bytearray(b"new"), "pdf"), ("m", bytearray(b"more"), "pdf")], "filename string, content binary, format string")
    later = {r.filename: r for r in registry.register_batch(again, files, stored, "b2", order="at").collect()}
    assert later["n"].logical_id == by_name["c"][3] and later["m"].reason == "suspected duplicate"


def test_a_thousand_revisions_share_one_document(spark):
    manifest = [ROW | {"filename": f"f{k}", "supersedes": f"f{k - 1}" if k else ""} for k in range(1000)]
    content = {r["filename"]: r["filename"].encode() for r in manifest}
    got = as_rows(decided(spark, manifest, content))
    assert got == one_by_one(manifest, content, [], "b")
    assert len({x[3] for x in got.values()}) == 1


def test_random_batches(spark):
    draw = random.Random(6)
    names = [f"f{k}" for k in range(60)]
    manifest = []
    for _ in range(120):
        other = draw.choice(names)
        cell = draw.choice(["", "", other, other, other, f"abolish: {other}", f"{other};f1"])
        manifest.append(ROW | {"filename": draw.choice([*names, "x.exe", ""]), "supersedes": cell, "title": draw.choice(["", "t", "u"]), "doc_number": draw.choice(["", "1", "2", "3"]), "perm_tag": draw.choice(["p", "p", "p", ""])})
    content = {n: draw.choice([n, n, n, "same"]).encode() for n in [*names, "x.exe"] if draw.random() < 0.85}
    known = [("v1", "l1", hashlib.sha256(b"f3").hexdigest(), "f7", "t", "1", "INDEXED")]
    assert as_rows(decided(spark, manifest, content, known)) == one_by_one(manifest, content, known, "b")


def test_roots_and_circles(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "a"), ("q", "p")], "node string, parent string")
    assert {tuple(r) for r in registry.chain_roots(links).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("x", "a"), ("q", "p")}
    assert registry.chain_roots(links.limit(0)).count() == 0
    with pytest.raises(ValueError):
        registry.chain_roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, parent string"))
