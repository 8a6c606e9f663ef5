import json

from siltflow.plans.cli import main


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "v.json").write_text(json.dumps({"variant": "v", "stages": {"keep": {"tool": "filter", "expression": "v.x > 1"}}}))
    (tmp_path / "bad.json").write_text(json.dumps({"variant": "bad", "stages": {"keep": {"tool": "nope"}}}))
    for part in ("input", "expected"):
        (tmp_path / "case" / part).mkdir(parents=True)
    (tmp_path / "case" / "input" / "seed.json").write_text('{"x":1}\n{"x":2}\n{"x":3}\n')
    expected = tmp_path / "case" / "expected" / "keep.json"
    expected.write_text('{"x":3}\n{"x":2}\n')
    folder, case, session = str(tmp_path), str(tmp_path / "case"), str(tmp_path / "s")
    assert main(["check", folder, "v"]) == 0 and main(["check", folder, "bad"]) == 1
    assert main(["run", folder, "v", "--input", f"{case}/input/seed.json", "--session", session], spark) == 0
    assert spark.read.json(f"{session}/keep").count() == 2
    assert main(["test", folder, "v", "--case", case, "--session", session], spark) == 0
    expected.write_text('{"x":3}\n{"x":4}\n')
    assert main(["test", folder, "v", "--case", case, "--session", session], spark) == 1
    assert "missing" in capsys.readouterr().err
