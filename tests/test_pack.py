"""Packs, configuration and allowlists."""

import json

import pytest

from auditlake.plans.pack import PACK_FILES, PackError, embedded_pack, load_folder, load_pack, parse_config, parse_suppress


def test_stock_pack():
    pack = embedded_pack()
    assert (len(pack.rules), len(pack.controls), len(pack.asi)) == (31, 49, 10)
    assert [len(pack.of_kind(k)) for k in ("single", "sequence", "taint", "shell")] == [19, 1, 6, 5]
    assert sum(c.status == "draft" for c in pack.controls) == 5
    assert not pack.warnings and pack.source_collapsed == "embedded-fallback"


def _folder(path, version=1):
    rows = {"rules": [{"agt_code": "A", "name": "a", "severity": 1, "default_confidence": 0.5, "signals": ["x"], "require_context": ["("], "unknown": 1}]}
    for key, (stem, field) in PACK_FILES.items():
        (path / f"{stem}.json").write_text(json.dumps({"schema_version": version, field: rows.get(key, [])}))


def test_folder(tmp_path):
    _folder(tmp_path)
    pack = load_folder(tmp_path)
    assert pack.rules[0].code == "A" and pack.rules[0].main.require == () and len(pack.warnings) == 1
    assert load_pack(tmp_path).source_collapsed == "file"
    assert load_pack(tmp_path / "none").source == "embedded-fallback"


def test_schema_gate(tmp_path):
    _folder(tmp_path, version=2)
    with pytest.raises(PackError):
        load_pack(tmp_path)


def test_suppress():
    a, b, c = parse_suppress("A:sig:src* # why\n\n# only a comment\n*:repo-file:tests/*\nB\n")
    assert (a.code, a.signal, a.source_glob, a.reason, a.raw) == ("A", "sig", "src*", "why", "A:sig:src*")
    assert (b.code, b.signal, b.source_glob, b.reason) == (None, "repo-file", "tests/*", "allowlisted")
    assert (c.code, c.signal) == ("B", None)


def test_config():
    config = parse_config('[thresholds]\nmin_confidence = 0.5\n[severity]\nA = 3\n[[suppress]]\nagt_code = "A"\nsource_glob = "x*"\n')
    assert config.min_confidence == 0.5 and config.severity == {"A": 3} and config.suppress[0].source_glob == "x*"
    with pytest.raises(ValueError):
        parse_config("[severity]\nA = 300\n")
