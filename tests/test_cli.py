import json

import pytest

from vaksetu import __main__ as cli


def test_build_stats_baseline(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name in ("train", "val", "test"):
        rows = [{"id": f"{name}{n}", "text": f"पहला वाक्य {n} है। दूसरा वाक्य यहाँ है।", "summary": f"पहला वाक्य {n}"} for n in range(5)] + [{"id": "x", "text": "क", "summary": "क"}]
        (raw / f"{name}.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    done, out = str(tmp_path / "done"), tmp_path / "out.json"
    cli.main(["build", "--input", str(raw), "--output", done])
    assert "train: kept 5, dropped 1" in capsys.readouterr().out
    cli.main(["stats", "--input", done, "--output", str(out)])
    assert {r["split"]: r["examples"] for r in json.loads(out.read_text(encoding="utf-8"))} == {"train": 5, "validation": 5, "test": 5}
    cli.main(["baseline", "--input", done, "--output", str(out), "--limit", "3"])
    found = json.loads(out.read_text(encoding="utf-8"))["systems"]
    assert found["lead_1"]["num_examples"] == 3 and found["oracle"]["rouge1_mean"] >= found["lead_1"]["rouge1_mean"] > 0.5
    cli.main(["summarize", "--text", "एक। दो। तीन।", "--sentences", "1"])
    assert capsys.readouterr().out.strip() == "एक।"
    with pytest.raises(SystemExit):
        cli.main(["summarize"])


def test_baseline_and_evaluate_give_intervals(tmp_path):
    done, out = tmp_path / "done" / "split=test", tmp_path / "out.json"
    done.mkdir(parents=True)
    rows = [{"id": f"t{n}", "text": f"पहला वाक्य {n} है। दूसरा वाक्य यहाँ है।", "summary": f"पहला वाक्य {n}"} for n in range(5)]
    (done / "rows.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    cli.main(["baseline", "--input", str(tmp_path / "done"), "--output", str(out)])
    one = json.loads(out.read_text(encoding="utf-8"))["systems"]["lead_1"]
    assert one["rouge1_ci95"]["low"] <= one["rouge1_mean"] <= one["rouge1_ci95"]["high"]
    made = tmp_path / "made.jsonl"
    made.write_text("\n".join(json.dumps({"system": "s", "id": r["id"], "prediction": r["text"], "reference": r["summary"]}, ensure_ascii=False) for r in rows), encoding="utf-8")
    cli.main(["evaluate", "--input", str(made), "--output", str(out)])
    assert "rougeL_ci95" in out.read_text(encoding="utf-8")


def test_infer_and_run_eval(tmp_path, capsys):
    cli.main(["infer", "--model", "vaksetu.operators.sequence:FirstWords", "--text", "एक दो तीन"])
    assert capsys.readouterr().out.strip() == "एक दो तीन"
    done, out = tmp_path / "done" / "split=test", tmp_path / "out.json"
    done.mkdir(parents=True)
    rows = [{"id": f"t{n}", "text": f"पहला वाक्य {n} है। दूसरा वाक्य यहाँ है।", "summary": f"पहला वाक्य {n}"} for n in range(5)]
    (done / "rows.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    arguments = ["run_eval", "--model", "vaksetu.operators.sequence:FirstWords", "--input", str(tmp_path / "done"), "--output", str(out), "--limit", "4", "--samples", "2"]
    cli.main(arguments)
    found = json.loads(out.read_text(encoding="utf-8"))
    assert found["num_examples"] == 4 and 0 < found["rouge1_mean"] < 1 and [s["id"] for s in found["samples"]] == ["t0", "t1"] and "low" in found["rougeL_ci95"]
    (done / "rows.json").write_text("", encoding="utf-8")
    cli.main(arguments)
    assert json.loads(out.read_text(encoding="utf-8"))["rouge1_mean"] == 0
