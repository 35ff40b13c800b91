"""Providers and hosts that misbehave: refusals, replies that cannot be read, odd paths, listings that are cut short."""

import http.client
import io
import json
import urllib.error

import pandas as pd
import pytest

from siltstone.operators import providers, report
from siltstone.sources import remote

GOOD = json.dumps({"cause": "a", "solution": "b"})
OPTIONS = {"api": "https://host", "raw": "https://raw", "owner": "o", "repo": "r", "branch": "main"}


@pytest.mark.parametrize("failing", [KeyError("choices"), IndexError(), ValueError("no JSON"), TypeError(), http.client.IncompleteRead(b""), urllib.error.URLError("x"), TimeoutError(), providers.Refused(500)])
def test_a_provider_that_fails_makes_a_row_unavailable(failing):
    def ask(prompt, credential):
        if credential == "bad" or prompt == "never":
            raise failing
        return GOOD

    frames = lambda: iter([pd.DataFrame({"finding_id": [1, 2], "prompt": ["p", "never"]})])
    assert list(pd.concat(providers.retrying(ask, ["bad", "good"], passes=2, wait=0)(frames())).unavailable) == [False, True]
    assert list(pd.concat(providers.retrying(ask, ["bad"], passes=2, wait=0)(frames())).unavailable) == [True, True]


@pytest.mark.parametrize("body, said", [
    ({"choices": [{"message": {"content": GOOD}}]}, GOOD), ({"choices": [{"message": {"content": "", "reasoning": f"so {GOOD} it is"}}]}, f"so {GOOD} it is"), ({"choices": [{"message": {"content": None, "reasoning": None}}]}, ""),
    ({"choices": [{"message": {"content": {"a": 1}}}]}, ""), ({"choices": []}, KeyError), ({}, KeyError), ([], KeyError), ({"choices": [{}]}, KeyError), ({"choices": [{"message": None}]}, KeyError),
])
def test_chat_replies(monkeypatch, body, said):
    sent = []
    monkeypatch.setattr(providers.urllib.request, "urlopen", lambda request, timeout: sent.append(request) or io.BytesIO(json.dumps(body).encode()))
    ask = providers.chat_provider("https://host/chat", "m", system="be brief")
    if said is KeyError:
        assert providers.attempts([(ask, "k")], passes=1)("p") is None
    else:
        assert ask("p", "k") == said
    assert sent[0].get_header("Authorization") == "Bearer k" and [m["role"] for m in json.loads(sent[0].data)["messages"]] == ["system", "user"]


@pytest.mark.parametrize("body, said", [({"candidates": [{"content": {"parts": [{"text": GOOD}]}}]}, GOOD), ({"candidates": []}, None), ({"candidates": [{"finishReason": "SAFETY"}]}, None), ({"candidates": [{"content": {"parts": []}}]}, None)])
def test_replies_in_parts(monkeypatch, body, said):
    sent = []
    monkeypatch.setattr(providers.urllib.request, "urlopen", lambda request, timeout: sent.append(request) or io.BytesIO(json.dumps(body).encode()))
    assert providers.attempts([(providers.parts_provider("https://host/x?alt=json", system="s"), "k&1")], passes=1)("p") == said
    assert sent[0].full_url == "https://host/x?alt=json&key=k%261" and json.loads(sent[0].data)["contents"][0]["parts"] == [{"text": "p"}]


def test_credentials_of_providers_take_turns():
    one, two = (lambda p, c: GOOD), (lambda p, c: "")
    assert providers.in_turn((one, ["a", " ", "b", "a"]), (two, ["c"])) == [(one, "a"), (two, "c"), (one, "b")] and providers.in_turn() == []
    began = []
    answer = providers.attempts([(lambda p, c: began.append(c) or GOOD, c) for c in "abc"], rotate=True)
    assert all(answer(f"prompt {i}") == GOOD for i in range(30)) and set(began) == {"a", "b", "c"}
    seen = []

    def refusing(prompt, credential):
        seen.append(credential)
        raise providers.Refused(401 if credential == "x" else 429)

    assert providers.attempts([(refusing, "x"), (refusing, "y")], passes=3, wait=0)("p") is None and seen == ["x", "y", "y", "y"]


def test_equal_prompts_are_asked_once_and_none_twice(spark, tmp_path):
    """A task that is begun again finds its replies; what could not be read is asked again by the next scan."""
    log = tmp_path / "asked"
    log.mkdir()
    findings = spark.createDataFrame([(i, f"prompt {i % 7}") for i in range(50)] + [(90, None), (91, "odd")], "finding_id long, prompt string")
    ledger = providers.Ledger(str(tmp_path / "ledger"))

    def answering(fail_on=None, odd="no JSON"):
        folder = str(log)

        def make():
            def answer(prompt):
                from uuid import uuid4

                with open(f"{folder}/{uuid4().hex}", "w") as f:
                    f.write(prompt)
                if prompt == fail_on:
                    raise RuntimeError("the executor is gone")
                return odd if prompt == "odd" and odd is None else json.dumps({"cause": f"of {prompt}", "solution": "s"})

            return answer

        return make

    asked = lambda: sorted(p.read_text() for p in log.iterdir())
    with pytest.raises(Exception, match="executor is gone"):
        providers.asked_once(findings, answering("prompt 3", odd=None), ledger, in_flight=1)
    before = len(asked())
    rows = {r.finding_id: r for r in providers.asked_once(findings, answering(odd=None), ledger, in_flight=2).collect()}
    assert len(rows) == 52 and rows[8].cause == "of prompt 1" and not rows[8].unavailable and rows[91].unavailable and rows[90].cause == "of "
    assert [p for p in asked() if p not in ("prompt 3", "odd")] == sorted(["", *(f"prompt {i}" for i in range(7) if i != 3)]) and len(asked()) >= before
    n = len(asked())
    assert providers.asked_once(findings, answering(), ledger).where("unavailable").count() == 0 and len(asked()) == n + 1
    joined = report.analyzed(findings.where("finding_id < 3"), report.unavailable)
    assert joined.columns == providers.asked_once(findings, answering(), ledger).columns


def test_paths_and_branches_are_quoted():
    asked = []

    class Stub(remote.RepositoryReader):
        def fetch(self, url):
            asked.append(url)
            if "/git/trees/" in url:
                return json.dumps({"tree": [{"type": "blob", "path": "a b/c#1?é.py", "size": 1}]}).encode()
            return b"x"

    reader = Stub(OPTIONS | {"branch": "feature/a b"})
    assert [r for part in reader.partitions() for r in reader.read(part)] == [("a b/c#1?é.py", "x", None)]
    assert asked == ["https://host/repos/o/r/git/trees/feature%2Fa%20b?recursive=1", "https://raw/o/r/feature/a%20b/a%20b/c%231%3F%C3%A9.py"]


def test_a_cut_reply_is_tried_again_and_then_skipped(monkeypatch):
    asked = []

    def fake(request, timeout):
        asked.append(request)
        raise http.client.IncompleteRead(b"half")

    monkeypatch.setattr(remote.urllib.request, "urlopen", fake)
    monkeypatch.setattr(remote, "WAIT", 0)
    assert list(remote.RepositoryReader(OPTIONS | {"skip_failures": "true"}).read(remote.Part(["a.py"]))) == [("a.py", None, "unreachable")] and len(asked) == 3


TREE = {"": {"x.py": 1, "src": {"y.py": 1, "deep": {"z.py": 1, "w.js": 1}, "node_modules": {"no.js": 1}}, "docs": {"a.py": 1}, "empty": {}}}


@pytest.mark.parametrize("most", [2, 3, 100])
def test_listings_that_are_cut_short_are_made_up_by_folders(most):
    """A host that lists at most so many entries, from the first on."""
    folders, asked = {}, []

    def number(node, name):
        folders[name] = node
        for k, v in node.items():
            if isinstance(v, dict):
                number(v, f"sha-{k}")

    number(TREE[""], "main")

    def entries(node, prefix=""):
        for k, v in node.items():
            yield {"path": prefix + k, "type": "tree", "sha": f"sha-{k}"} if isinstance(v, dict) else {"path": prefix + k, "type": "blob", "size": v}
            if isinstance(v, dict):
                yield from entries(v, f"{prefix}{k}/")

    class Stub(remote.RepositoryReader):
        def fetch(self, url):
            asked.append(url)
            name, deep = url.rpartition("/")[2].partition("?")[0], "recursive" in url
            every = [e for e in entries(folders[name]) if deep or "/" not in e["path"]]
            return json.dumps({"tree": every[: most + 2 if not deep else most], "truncated": len(every) > (most + 2 if not deep else most)}).encode()

    reader = Stub(OPTIONS)
    assert [p for part in reader.partitions() for p in part.items] == ["docs/a.py", "src/deep/w.js", "src/deep/z.py", "src/y.py", "x.py"]
    assert not any("node_modules" in u for u in asked) and (len(asked) == 1) == (most == 100)
