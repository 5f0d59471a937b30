"""Running programs of the corpus: child processes with limits, and the checks made of their results.

Off by default: programs are code. `trusted=True` says that the caller vouches for them;
the child process bounds time and memory and is no security boundary.
"""

from __future__ import annotations

import ast
import json
import os
import select
import subprocess
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dealt

#: What a job is; jobs that are equal in all of it are run once.
JOB = ("program", "function", "args", "seed")
#: Characters of jobs and results that a task remembers.
REMEMBERED = 1 << 25
RESULT = "status STRING, output STRING, error STRING"
BLOCKED = {"os", "sys", "subprocess"}
#: One interpreter for each task: it imports numpy once and forks for every job, so a job costs a fork and can be killed by itself. numpy.random is named since numpy imports it on first use only, which would be in every fork.
_SERVER = r"""
import json, os, random, resource, select, signal, sys
import numpy, numpy.random
for line in sys.stdin:
    job = json.loads(line)
    out, into = os.pipe()
    pid = os.fork()
    if not pid:
        os.close(out)
        sys.stdout = sys.stderr = open(os.devnull, "w")
        resource.setrlimit(resource.RLIMIT_CPU, (int(job["timeout"]) + 1,) * 2)
        resource.setrlimit(resource.RLIMIT_AS, (job["memory"], job["memory"]))
        try:
            space = {"__name__": "program"}
            random.seed(job["seed"]); numpy.random.seed(job["seed"] % 2**32)
            exec(compile(job["program"], "program", "exec"), space)
            args = [numpy.array(a) for a in job["args"]]
            got = space[job["function"]](*args)
            got = got.tolist() if hasattr(got, "tolist") else got
            said = {"status": "ok", "output": json.dumps(got), "error": None}
        except BaseException as e:
            said = {"status": "error", "output": None, "error": f"{type(e).__name__}: {e}"[:500]}
        with os.fdopen(into, "w") as f:
            f.write(json.dumps(said))
        os._exit(0)
    os.close(into)
    parts, said = [], None
    while True:
        if not select.select([out], [], [], job["timeout"])[0]:
            said = {"status": "timeout", "output": None, "error": None}
            break
        part = os.read(out, 1 << 16)
        if not part:
            break
        parts.append(part)
    os.close(out)
    if said:
        os.kill(pid, signal.SIGKILL)
    os.waitpid(pid, 0)
    text = b"".join(parts).decode()
    print(json.dumps(said or (json.loads(text) if text else {"status": "error", "output": None, "error": "no result"})), flush=True)
"""


@lru_cache(1024)
def blocked(program: str) -> bool:
    """Whether the program imports what it may not, wherever that stands; one that does not parse fails by itself."""
    try:
        tree = ast.parse(program)
    except (SyntaxError, ValueError, RecursionError):
        return False
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        if any(n.split(".")[0] in BLOCKED for n in names) or isinstance(node, ast.Name) and node.id in ("__import__", "__builtins__"):
            return True
    return False


class Runner:
    """Runs programs one after the other in children of one interpreter."""

    def __init__(self):
        self.server = None

    def __enter__(self) -> Runner:
        return self

    def __exit__(self, *_) -> None:
        if self.server is not None:
            self.server.kill()
            self.server.wait()
            self.server.stdin.close()
            self.server.stdout.close()
            self.server = None

    def run(self, program: str, function: str, args: list, seed: int = 0, timeout: float = 1.0, memory: int = 4 << 30) -> dict:
        """Status ok, error or timeout, the output as JSON, and the error's text."""
        if blocked(program):
            return {"status": "error", "output": None, "error": "blocked import"}
        if self.server is None:
            self.server = subprocess.Popen([sys.executable, "-I", "-c", _SERVER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=os.environ | {"OPENBLAS_NUM_THREADS": "1"})  # a fork has none of the threads
            first = 60.0  # numpy is imported
        else:
            first = 2.0
        try:
            self.server.stdin.write(json.dumps({"program": program, "function": function, "args": args, "seed": seed, "timeout": timeout, "memory": memory}) + "\n")
            self.server.stdin.flush()
            if select.select([self.server.stdout], [], [], timeout + first)[0] and (line := self.server.stdout.readline()):
                return json.loads(line)
        except (OSError, ValueError):
            pass
        self.__exit__()  # it hangs or is gone: the next job starts another
        return {"status": "timeout", "output": None, "error": None}


def run_program(program: str, function: str, args: list, seed: int = 0, timeout: float = 1.0) -> dict:
    with Runner() as r:
        return r.run(program, function, args, seed, timeout)


class Memory:
    """Results of jobs by what was run, the oldest let go of beyond `most` characters; a job that is asked for again after that is run again."""

    def __init__(self, most: int = REMEMBERED):
        self.known, self.held, self.most = {}, 0, most

    def of(self, job: tuple, run) -> dict:
        if job not in self.known:
            self.known[job] = run()
            self.held += self._size(job)
            while self.held > self.most and len(self.known) > 1:
                self.held -= self._size(first := next(iter(self.known)))
                del self.known[first]
        return self.known[job]

    def _size(self, job: tuple) -> int:
        return sum(len(x) for x in (*job, *self.known[job].values()) if isinstance(x, str))


def execute(jobs: DataFrame, trusted: bool = False, timeout: float = 1.0, partitions: int | None = None) -> DataFrame:
    """jobs: (program, function, args: JSON list of grids, seed, ...). Adds status, output (JSON) and error; results keep their row, so their order needs no care.

    Jobs are dealt to all cores, as a process each costs far more than its row's bytes show.
    Equal jobs meet in one task and are run once, as far as a task remembers: a program that
    heeds its seed gives the same each time.
    """
    if not trusted:
        raise PermissionError("programs are run only where trusted=True is given")
    out = T.StructType([*jobs.schema.fields, *T.StructType.fromDDL(RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        with Runner() as runner:
            for b in batches:
                got = []
                for p, f, a, s in zip(*[b.column(c).to_pylist() for c in JOB], strict=True):
                    job = (p, f, a or "[]", int(s or 0))
                    got.append(memory.of(job, lambda job=job: runner.run(job[0], job[1], json.loads(job[2]), job[3], timeout)))
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([g[k] for g in got], pa.string()) for k in ("status", "output", "error")]], names=out.names)

    return dealt(jobs, *JOB, tasks=partitions).mapInArrow(run, out)


def first_valid(samples: DataFrame, by: str = "problem", order: str = "ord") -> DataFrame:
    """The first sample of each problem that is valid."""
    return samples.filter("valid").groupBy(by).agg(F.min(order).alias(order)).join(samples, [by, order])


def verdicts(checks: DataFrame) -> DataFrame:
    """checks: (problem, grid_idx, deterministic, well_formed, all_black, colour_runs, colour_formed, equivariant, identity). For each grid the first check that fails, in that order; for each problem whether it stands, and why not.

    A grid that only is malformed, black or unchanged is skipped; the other failures end the problem at the first such grid.
    """
    reason = (
        F.when(~F.col("deterministic"), "non_deterministic")
        .when(~F.col("well_formed"), "non_well_formed")
        .when(F.col("all_black"), "black")
        .when(~F.col("colour_runs"), "colour_count")
        .when(~F.col("colour_formed"), "colour_form")
        .when(~F.col("equivariant"), "non_colour_invariant")
        .when(F.col("identity"), "identity")
    )
    fatal = F.col("reason").isin("non_deterministic", "colour_count", "colour_form", "non_colour_invariant")
    marked = checks.withColumn("reason", reason)
    return marked.groupBy("problem").agg(
        F.min_by(F.when(fatal, F.col("reason")), F.when(fatal, F.col("grid_idx"))).alias("ended_by"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count("*").alias("tried"),
    )
