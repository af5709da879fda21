"""The commands, JSON lines in and out."""

import json
import random

from millrace.__main__ import main

RECORD = {"vendor_name": "Ä GmbH", "vendor_address": "x", "invoice_number": "1", "invoice_date": "2024-01-02", "due_date": None, "bill_to": "b", "line_items": [{"description": "d", "quantity": 1, "unit_price": 150.0, "total": 150.0}], "subtotal": 150.0, "tax_amount": 12.0, "tax_rate": 0.08, "total_amount": 162.0, "currency": "EUR", "payment_terms": None, "notes": None}


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def test_chain_of_commands(spark, tmp_path):
    rng = random.Random(5)
    rows = [{"id": f"e{k:03d}", "scenario_id": "s", "difficulty": "easy", "document_text": f"Invoice {k} " + " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)), "ground_truth_json": RECORD} for k in range(130)]
    rows += [rows[0] | {"id": "copy"}, rows[1] | {"id": "bad", "ground_truth_json": {"total_amount": 1}}, rows[2] | {"id": "short", "document_text": "short 1"}]
    (tmp_path / "raw.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    t = str(tmp_path)
    out = main(["validate", "--input", f"{t}/raw.jsonl", "--output", f"{t}/valid", "--rejected", f"{t}/failed", "--summary", f"{t}/summary"], spark)
    assert (out["n_total"], out["n_valid"], out["n_failed"]) == (133, 132, 1) and lines(tmp_path / "failed")[0]["id"] == "bad"
    out = main(["dedup", "--input", f"{t}/valid", "--output", f"{t}/kept", "--rejected", f"{t}/copies"], spark)
    assert out["removed"] == 1 and lines(tmp_path / "copies")[0]["duplicate_of"] in ("copy", "e000")
    out = main(["filter", "--input", f"{t}/kept", "--output", f"{t}/good", "--rejected", f"{t}/poor"], spark)
    assert out["removed"] == 1 and out["reasons"]["doc_too"] == 1
    out = main(["split", "--input", f"{t}/good", "--output", f"{t}/parts"], spark)
    assert sum(out["sizes"].values()) == 130 and out["sizes"]["eval"] == 50 and len(out["eval_sha256"]) == 64
    out = main(["format", "--input", f"{t}/parts/train", "--output", f"{t}/chat"], spark)
    assert out["skipped"] == 0
    # targets keep the order of keys and the form of numbers
    assert {c["conversations"][2]["value"] for c in lines(tmp_path / "chat")} == {json.dumps(RECORD, ensure_ascii=False, separators=(",", ":"))}
    answers = [{"id": r["id"], "raw_output": json.dumps(RECORD), "latency": 0.5} for r in lines(tmp_path / "parts/eval")]
    (tmp_path / "predictions.jsonl").write_text("\n".join(map(json.dumps, answers[:-5])))
    out = main(["eval", "--input", f"{t}/parts/eval", "--predictions", f"{t}/predictions.jsonl", "--output", f"{t}/results/finetuned", "--locked"], spark)
    assert out["n_examples"] == 50 and out["latency_p50_seconds"] == 0.5 and abs(out["aggregate"]["schema_validity_rate"] - 0.9) < 1e-9
    out = main(["compare", "--input", f"{t}/results"], spark)
    assert out["quality"]["schema_validity_rate"]["finetuned"] == "90.0%" and out["quality"]["schema_validity_rate"]["base"] == "not available"
    assert len(main(["schema"], spark)["fields"]) == 14 and main(["cost"], spark)["cost_per_1000"] > 0
