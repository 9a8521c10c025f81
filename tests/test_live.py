import json

import samples

from reviewlake.operators import assembly, validation as V
from reviewlake.plans import live
from reviewlake.schemas import LIVE, STAGES

START = 1_933_135_628_000_000


def answers():
    doc = samples.report()
    return {"analyze": doc["analysis"], "fix": doc["fix"], "test": doc["tests"], "report": doc["report"]}


def test_live_reports(spark):
    rows, good = [], answers()
    for n, stage in enumerate(STAGES):
        text = f"Sure!\n```json\n{json.dumps(good[stage])}\n```"
        at = START + n * 10_000_000
        rows.append(("ok", stage, 1, text, at, at + 1_500_000))
        # The second run needs a retry for every stage.
        rows.append(("retried", stage, 1, "no JSON", at, at + 1_000_000))
        rows.append(("retried", stage, 2, text, at + 1_000_000, at + 2_250_400))
        if stage in ("analyze", "fix"):
            rows.append(("failed", stage, 1, text if stage == "analyze" else "{}", at, at + 1))
    rows += [("failed", "fix", 2, "{", START, START + 9), ("failed", "fix", 3, json.dumps(good["fix"]), START, START + 9)]
    responses = spark.createDataFrame(rows, "run string, stage string, attempt int, text string, started bigint, ended bigint")
    requests = spark.createDataFrame(
        [(r, "x\n", "typescript", "snippet.ts") for r in ("ok", "retried", "failed", "waiting")],
        "run string, code string, language string, file_name string",
    )
    built = live.live_reports(requests, responses, "m-1", "by the clock")
    assert {r.run: (r.reason, r.detail) for r in built.rejected.collect()} == {
        "failed": ("fix stage failed", "no_object"), "waiting": ("analyze stage failed", "no answer"),
    }
    texts = built.reports.select(assembly.report_json().alias("text"))
    assert V.validate_reports(texts, "text").rejected.count() == 0
    docs = {d["id"]: d for d in (json.loads(r.text) for r in texts.collect())}
    assert set(docs) == {"ok", "retried"}
    doc = docs["ok"]
    assert (doc["analysis"], doc["fix"], doc["tests"], doc["report"]) == tuple(good[s] for s in STAGES)
    assert doc["source"] == {"kind": LIVE, "model": "m-1", "recordedAt": "2031-04-05T06:07:39.500Z"}
    assert doc["title"] == "snippet.ts" and "verification" not in doc and "detection" not in doc
    assert doc["timings"]["totalMs"] == 6000 and docs["retried"]["timings"]["totalMs"] == 4 * 2250
