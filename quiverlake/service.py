"""A thin HTTP service and command line over the engine.

    python -m quiverlake.service --base DIR serve --dim 128 --nprobe 10 --port 8080
    python -m quiverlake.service --base DIR index -k 0 --iters 25

POST /write {"id", "vector"}, /delete {"id"}, /query {"vector", "k"}. Bad requests get 400, failures of the store 500.
"""

from __future__ import annotations

import argparse
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.replay import latest
from .plans import catalog, ivf
from .plans.search import hybrid
from .schema import OPLOG, Op, check_id, check_k, check_vector
from .sources.binlog import read_oplog
from .sources.store import Store
from .streaming.ingest import Writer, last_seq

#: Merges of new files into the operations in memory before these are read anew.
MERGES = 32


class Engine:
    """Index, and in memory what the log holds beyond it: the last operation of each id, advanced by new files alone."""

    def __init__(self, spark: SparkSession, base: str, dim: int = 128, nprobe: int = 10):
        self.spark, self.store, self.dim, self.nprobe = spark, Store(spark, base), dim, nprobe
        self.writer, self.lock = Writer(self.store, dim), threading.Lock()
        self.refresh()

    def refresh(self) -> None:
        """Look for a newer published index; the log is then read anew from where it ends."""
        try:
            self.index = ivf.open_latest(self.spark, self.store)
        except catalog.NoManifestError:
            self.index = None
        self.recent, self.seen, self.steps = self.spark.createDataFrame([], OPLOG), self.index.seq if self.index else 0, 0

    def log(self):
        """The last operations since the index, with what has come to the log by now."""
        with self.lock:
            end = last_seq(self.store)
            if end > self.seen:
                if self.steps == MERGES:  # plans do not grow without end
                    self.refresh()
                fresh = read_oplog(self.spark, self.store.path("wal"), self.seen).filter(F.col("seq") <= end)
                merged = latest(self.recent.unionByName(fresh), self.dim).persist()
                merged.count()
                self.recent.unpersist()
                self.recent, self.seen, self.steps = merged, end, self.steps + 1
            return self.recent

    def write(self, body: dict) -> dict:
        name, vector = check_id(str(body["id"])), check_vector([float(x) for x in body["vector"]], self.dim)
        self.writer.write([(Op.UPSERT, name, vector)])
        return {"id": name}

    def delete(self, body: dict) -> dict:
        name = check_id(str(body["id"]))
        self.writer.write([(Op.DELETE, name, None)])
        return {"id": name}

    def query(self, body: dict) -> dict:
        vector, k = check_vector([float(x) for x in body["vector"]], self.dim), check_k(int(body["k"]))
        queries = self.spark.createDataFrame([(0, vector)], "query_id bigint, vector array<float>")
        rows = hybrid(queries, k, self.log(), self.index, self.nprobe, self.dim).orderBy("rank").collect()
        return {"results": [{"id": r.id, "score": r.score} for r in rows]}


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            action = {"/write": engine.write, "/delete": engine.delete, "/query": engine.query}.get(self.path)
            try:
                if action is None:
                    return self._say(404, {"error": "no such path"})
                self._say(200, action(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))))
            except (ValueError, KeyError, TypeError) as e:
                self._say(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001
                self._say(400 if self.path == "/query" else 500, {"error": str(e)[:500]})

        def _say(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return Handler


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quiverlake.service")
    parser.add_argument("--base", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    serve, index = commands.add_parser("serve"), commands.add_parser("index")
    serve.add_argument("--dim", type=int, default=128)
    serve.add_argument("--nprobe", type=int, default=10)
    serve.add_argument("--port", type=int, default=8080)
    index.add_argument("-k", type=int, default=0)
    index.add_argument("--iters", type=int, default=25)
    options = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if options.command == "index":
        store = Store(spark, options.base)
        status, manifest = ivf.build_index(spark, store, read_oplog(spark, store.path("wal")), options.k or None, options.iters)
        print(status, manifest or "")
        return 0
    engine = Engine(spark, options.base, options.dim, options.nprobe)
    ThreadingHTTPServer(("", options.port), handler(engine)).serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
