import random

import pytest

from logweave.operators import segmentation

FORMATS = {
    "apache_error": (lambda k: f"[Sat Nov {k % 28 + 1:02d} 10:{k % 60:02d}:12.345678 2026] [core:error] [pid {k}] failed to open", ["  stack one", "caused by: something", "\tat x.y(z)"]),
    "epoch": (lambda k: f"17958{k:05d}.{k % 1000:03d} {k} worker-{k % 7} took it", ["more of the same", "  and more"]),
    "dotted": (lambda k: f"2026.11.{k % 28 + 1}-10.{k % 60}.{k % 59} lvl={k % 5} start of job", ["detail line", "    x = 12"]),
    "two": (lambda k: f"@{k % 24:02d}h{k % 60:02d}m{k % 60:02d}s up" if k % 3 else f"#{k} ({k % 12}/{k % 28}/26 {k % 24}:{k % 60}) down", ["detail", "  other"]),
}


@pytest.mark.parametrize("name", list(FORMATS))
def test_headers_of_unseen_formats(spark, name):
    rng = random.Random(3)
    make, inner = FORMATS[name]
    rows, wanted = [], 0
    for k in range(1, 200):
        rows.append(make(k))
        wanted += 1
        rows += [rng.choice(inner) for _ in range(rng.randrange(3))]
    frame = spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)], "file string, line_no long, line string")
    assert segmentation.validate(frame).first()["header_matches"] == 0
    found = segmentation.settle(frame)
    assert found.verified and found.origin == "candidate"
    events = segmentation.assemble(frame, found.header)
    assert events.count() == wanted and events.where("not first_line_is_header").count() == 0


def test_lines_without_times(spark):
    frame = spark.createDataFrame([("f", k, r) for k, r in enumerate(["plain", "words", "", "1 2"])], "file string, line_no long, line string")
    assert segmentation.induce(frame) == [] and segmentation.induce(frame.limit(0)) == []
    assert not segmentation.settle(frame, strict=False).verified
