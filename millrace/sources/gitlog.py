"""Commits of git repositories as a data source: spark.read.format("millrace_git").

Options: `path` (a repository in a folder that every executor reaches, or several, a line each), `since` and `until`
(as git understands them), `slice` (commits a partition).  A repository's history, as of the commit its HEAD names when
the query is planned, is cut into slices that tasks read on their own; only commit ids are walked to reach a slice,
diffs are taken of its own commits.  Comparisons of `at` and `repo` with literals go to git and to the choice of repositories;
Spark asks for spark.sql.python.filterPushdown.enabled with a source that takes them.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SLICE = 5000
SCHEMA = "repo string, sha string, at timestamp, author string, subject string, files array<string>, insertions long, deletions long"
_FORMAT = "--pretty=format:%x1e%H%x1f%cI%x1f%an%x1f%s%x1f"


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="replace")


def parse_record(text: str) -> tuple:
    """sha, at, author, subject, files, insertions, deletions of one record; a binary file has no line counts but is a file."""
    sha, at, author, subject, stat = text.lstrip().split("\x1f", 4)
    rows = [x.strip().split("\t") for x in stat.split("\n") if x.strip()]
    rows = [x for x in rows if len(x) >= 3]
    total = lambda i: sum(int(x[i]) for x in rows if x[i].isdigit())
    return sha, datetime.fromisoformat(at).astimezone(timezone.utc), author, subject, [x[2] for x in rows], total(0), total(1)


@dataclass
class Slice(InputPartition):
    repo: str
    head: str
    skip: int


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


class GitReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repos = [x.strip() for x in options["path"].split("\n") if x.strip()]
        self.size = int(options.get("slice", SLICE))
        self.range = [f"--{k}={options[k]}" for k in ("since", "until") if options.get(k)]
        self.least: datetime | None = None  # both inclusive
        self.most: datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tick = timedelta(microseconds=1)
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("repo",) and isinstance(f, EqualTo):
                self.repos = [x for x in self.repos if x == value]
            elif column == ("at",) and isinstance(value, datetime) and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                at = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    at = at + tick if isinstance(f, GreaterThan) else at
                    self.least = at if self.least is None else max(self.least, at)
                else:
                    at = at - tick if isinstance(f, LessThan) else at
                    self.most = at if self.most is None else min(self.most, at)
            else:
                yield f

    def _bounds(self) -> list[str]:
        """For git, which reckons in seconds: a second wider, cut to the bounds when read."""
        out = list(self.range)
        if self.least is not None and not any(x.startswith("--since") for x in out):
            out.append(f"--since={(self.least - timedelta(seconds=1)).isoformat()}")
        if self.most is not None and not any(x.startswith("--until") for x in out):
            out.append(f"--until={(self.most + timedelta(seconds=1)).isoformat()}")
        return out

    def partitions(self) -> list[Slice]:
        out = []
        for repo in self.repos:
            head = git(repo, "rev-parse", "HEAD").strip()
            n = int(git(repo, "rev-list", "--count", "--no-merges", *self._bounds(), head))
            out += [Slice(repo, head, k) for k in range(0, n, self.size)]
        return out or [Slice("", "", 0)]

    def read(self, part: Slice) -> Iterator[tuple]:
        if not part.repo:
            return
        text = git(part.repo, "log", "--no-merges", "--numstat", _FORMAT, f"--skip={part.skip}", f"--max-count={self.size}", *self._bounds(), part.head)
        for record in text.split("\x1e"):
            if record.strip():
                row = parse_record(record)
                if (self.least is None or row[1] >= self.least) and (self.most is None or row[1] <= self.most):
                    yield part.repo, *row
