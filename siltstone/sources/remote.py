"""A repository host as Spark data sources: what to read is planned on the driver, the tasks fetch it.

    for source in (RepositorySource, StatusSource, HistorySource):
        spark.dataSource.register(source)
    spark.read.format("repository").option("owner", o).option("repo", r).option("branch", b).load()     # file, source
    spark.read.format("repository_status").option("owner", o).option("repo", r).load()                  # one row
    spark.read.format("repository_history").option("owner", o).option("repo", r).option("kind", "issue").load()

Options `api` and `raw` name the host's addresses; `token` is sent as a bearer and never logged. A request that fails is
tried again; one that keeps failing ends the job, as part of a repository is no repository, unless `skip_failures` is
true: then it gives a row with a null source and its reason in `failure`. A file that holds a NUL or is not UTF-8 gives no
row. A listing that the host has cut short is made up folder by folder, in rounds; only a single folder that is cut short
is an error, unless `allow_truncated` is true.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from http.client import HTTPException
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.sources.files import REMOTE_SKIP_ENDINGS, SKIP_FOLDERS, SOURCE_EXTENSIONS

FILES_A_TASK, SECONDS, ATTEMPTS, WAIT = 50, 25, 3, 1.0
#: Folders whose listings are asked for at once.
LISTINGS = 8
PAGE, MOST_ITEMS, MOST_COMMENTS, PATCH_CHARS = 100, 30, 20, 30_000


def wanted(entry: dict) -> bool:
    path = entry.get("path") or ""
    *folders, name = path.lower().split("/")
    dot = name.rfind(".")
    return bool(entry.get("type") == "blob" and isinstance(entry.get("size"), int) and entry["size"] > 0 and not set(folders) & set(SKIP_FOLDERS) and not name.endswith(tuple(REMOTE_SKIP_ENDINGS)) and dot > 0 and name[dot:] in SOURCE_EXTENSIONS)


def paginated(fetch: Callable[[str], bytes], url: str, most: int) -> list[dict]:
    """Items of a paged listing, at most `most`: pages are asked for until one is short, empty or no list."""
    found: list[dict] = []
    size, page = min(PAGE, most), 1
    while 0 < size and len(found) < most:
        items = json.loads(fetch(f"{url}{'&' if '?' in url else '?'}page={page}&per_page={size}"))
        if not isinstance(items, list) or not items:
            break
        found += items
        if len(items) < size:
            break
        page += 1
    return found[:most]


def reason(error: Exception) -> str:
    """A failed request in a few words, without its address."""
    if isinstance(error, urllib.error.HTTPError):
        limited = error.code == 403 and error.headers.get("X-RateLimit-Remaining") == "0"
        return "rate limit exceeded" if limited else {401: "credentials rejected", 403: "access denied", 404: "not found"}.get(error.code, f"status {error.code}")
    return "unreachable"


class Part(InputPartition):
    def __init__(self, items: list):
        self.items = items


class HostReader(DataSourceReader):
    """Requests with the options' token, tried again after what may pass."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def fetch(self, url: str) -> bytes:
        request = urllib.request.Request(url)
        if token := self.options.get("token"):
            request.add_header("Authorization", f"Bearer {token}")
        for attempt in range(ATTEMPTS):
            try:
                with urllib.request.urlopen(request, timeout=SECONDS) as reply:
                    return reply.read()
            except (OSError, HTTPException) as e:  # the latter: a reply that breaks off
                lasting = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429
                if lasting or attempt == ATTEMPTS - 1:
                    raise
                time.sleep(WAIT * (attempt + 1))
        raise AssertionError

    def on(self, name: str) -> bool:
        return str(self.options.get(name, "")).lower() == "true"

    def address(self, tail: str) -> str:
        o = self.options
        return f"{o['api']}/repos/{quote(o['owner'], safe='')}/{quote(o['repo'], safe='')}{tail}"


class RepositoryReader(HostReader):
    def partitions(self) -> list[InputPartition]:
        paths = sorted({e["path"] for e in self.listed() if wanted(e)})
        if not paths:
            raise ValueError("the repository has no source files")
        return [Part(paths[k : k + FILES_A_TASK]) for k in range(0, len(paths), FILES_A_TASK)]

    def listed(self) -> list[dict]:
        """The entries of the branch, with their whole paths.

        A folder is asked for with all that is in it. If the host cuts that short, its own entries are asked for, and its
        folders are the next round's; those whose names are skipped anyway are not entered."""
        found: list[dict] = []
        round_ = [("", str(self.options["branch"]))]
        with ThreadPoolExecutor(LISTINGS) as pool:
            while round_:
                deep = list(pool.map(lambda f: self.listing(f[1], True), round_))
                cut = [f for f, (_, short) in zip(round_, deep, strict=True) if short]
                for (prefix, _), (entries, short) in zip(round_, deep, strict=True):
                    if not short:
                        found += [e | {"path": prefix + e["path"]} for e in entries]
                flat = list(pool.map(lambda f: self.listing(f[1], False), cut))
                round_ = []
                for (prefix, _), (entries, short) in zip(cut, flat, strict=True):
                    if short and not self.on("allow_truncated"):
                        raise ValueError(f"the host cut the listing of {prefix or 'the root'} short; allow_truncated takes what there is")
                    whole = [e | {"path": prefix + e["path"]} for e in entries]
                    found += whole
                    round_ += [(f"{e['path']}/", e["sha"]) for e in whole if e.get("type") == "tree" and e.get("sha") and e["path"].rpartition("/")[2].lower() not in SKIP_FOLDERS]
        return found

    def listing(self, tree: str, deep: bool) -> tuple[list[dict], bool]:
        """Entries of a tree, and whether the host has cut them short."""
        reply = json.loads(self.fetch(self.address(f"/git/trees/{quote(tree, safe='')}{'?recursive=1' if deep else ''}")))
        return [e for e in reply.get("tree") or [] if isinstance(e, dict) and e.get("path")], bool(reply.get("truncated"))

    def read(self, partition: Part) -> Iterator[tuple[str, str | None, str | None]]:
        o = self.options
        for path in partition.items:
            try:
                content = self.fetch("/".join((o["raw"], *(quote(str(x)) for x in (o["owner"], o["repo"], o["branch"], path)))))
            except (OSError, HTTPException) as e:
                if not self.on("skip_failures"):
                    raise ValueError(f"{path}: {reason(e)}") from e
                yield path, None, reason(e)
                continue
            if b"\x00" not in content:
                try:
                    yield path, content.decode("utf-8"), None
                except UnicodeDecodeError:
                    continue


class StatusReader(HostReader):
    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        try:
            found = json.loads(self.fetch(self.address("")))
            yield o["owner"], o["repo"], "valid", None, found.get("full_name") or f"{o['owner']}/{o['repo']}", found.get("default_branch") or "main", found.get("description"), bool(found.get("private"))
        except (OSError, HTTPException, ValueError, AttributeError) as e:
            yield o["owner"], o["repo"], "invalid", reason(e) if isinstance(e, (OSError, HTTPException)) else "no JSON", None, None, None, None


class HistoryReader(HostReader):
    """The latest issues, or pull requests with their patches, and the first comments of each."""

    def partitions(self) -> list[InputPartition]:
        kind = self.options.get("kind", "issue")
        most = int(self.options.get("most", MOST_ITEMS))
        path = "/issues" if kind == "issue" else "/pulls"
        items = paginated(self.fetch, self.address(f"{path}?state=all&sort=updated&direction=desc"), 2 * most)
        items = [i for i in items if kind != "issue" or not i.get("pull_request")][:most]
        return [Part([i]) for i in items]

    def read(self, partition: Part) -> Iterator[tuple]:
        o = self.options
        for item in partition.items:
            number, comments, patch = item.get("number"), [], None
            if number is not None:
                comments = [c.get("body") for c in paginated(self.fetch, self.address(f"/issues/{number}/comments"), MOST_COMMENTS)]
                if o.get("kind", "issue") != "issue":
                    patch = self.fetch(self.address(f"/pulls/{number}.patch")).decode("utf-8", "replace")[:PATCH_CHARS]
            labels = [(x.get("name") if isinstance(x, dict) else str(x),) for x in item.get("labels") or []]
            yield f"{o['owner']}/{o['repo']}", number, item.get("title"), item.get("body"), item.get("state"), labels, comments, item.get("html_url"), item.get("created_at"), item.get("updated_at"), item.get("merged_at"), patch


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "file string, source string, failure string"

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


class StatusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_status"

    def schema(self) -> str:
        return "owner string, repo string, status string, message string, full_name string, default_branch string, description string, private boolean"

    def reader(self, schema) -> StatusReader:
        return StatusReader(self.options)


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_history"

    def schema(self) -> str:
        return "repo string, number long, title string, body string, state string, labels array<struct<name: string>>, comments array<string>, html_url string, created_at string, updated_at string, merged_at string, patch string"

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def token_status(token: str | None) -> str:
    """Whether there is a token, and its first four signs."""
    return f"present ({token[:4]}...)" if token and token.strip() else "absent"
