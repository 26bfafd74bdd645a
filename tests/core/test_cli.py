import argparse
import json
import sys
import threading
from pathlib import Path

import pytest

from roadloom import cli


def test_coordinates():
    assert cli.coordinates("57.1,24.5") == (57.1, 24.5)
    for bad in ("57.1", "a,b", "91,0", "1,2,3"):
        with pytest.raises(argparse.ArgumentTypeError):
            cli.coordinates(bad)


def test_schema(tmp_path):
    cli.main(["rule-schema", "--output", str(tmp_path / "s.json")])
    assert json.loads((tmp_path / "s.json").read_text())["additionalProperties"] is False


def test_errors_are_answers():
    said = json.loads(cli.answer(None, {"id": "x", "start": [1, 2], "rules": {"nope": 1}}))
    assert said["id"] == "x" and "nope" in said["result"]["error"]["message"]


def test_client_and_server():
    with cli.serve(None, "127.0.0.1", 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        said = json.loads(cli.ask("127.0.0.1", server.server_address[1], {"id": "y", "start": [1, 2], "rules": {"nope": 1}}))
        assert said["id"] == "y" and "nope" in said["result"]["error"]["message"]
        server.shutdown()


def test_entry_without_the_optional_queries(monkeypatch):
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "roadloom.llm.queries", None)
    assert "edges" in entry.queries() and "op1_bpe" not in entry.queries() and "edges" in entry.oracle_sql()
    monkeypatch.undo()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries()
