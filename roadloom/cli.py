"""Command line: generate routes, prepare a cache, write the rules' schema, serve requests over a local socket and send them,
serve the pages of a trace."""

from __future__ import annotations

import argparse
import http.server
import json
import socket
import socketserver
import struct
import sys
import urllib.parse

from pyspark.sql import SparkSession

from roadloom.operators import trace
from roadloom.plans.generate import Roads, generate
from roadloom.sources import cache, osm_json, rules, sinks


def coordinates(text: str) -> tuple[float, float]:
    """LAT,LON."""
    try:
        lat, lon = (float(x) for x in text.split(","))
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text}: LAT,LON is expected") from None
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise argparse.ArgumentTypeError(f"{text}: no place on earth")
    return lat, lon


def roads(spark: SparkSession, source: str, folder: str | None) -> Roads:
    """A map file's graph, from the cache if there is one of this very file; else it is written there."""
    found = cache.read(spark, folder, source) if folder else None
    if found is None:
        made = Roads.of(osm_json.read(spark, source))
        if not folder:
            return made
        cache.write(folder, source, {"nodes": made.nodes, "lines": made.lines, "restrictions": made.restrictions, "degrees": made.degrees})
        found = cache.read(spark, folder, source)
    return Roads(found["nodes"], found["lines"], found["restrictions"], found["degrees"])


def answer(graph: Roads, request: dict) -> str:
    """The JSON response to {id, start: [lat, lon], finish: [lat, lon] | null, bearing, distance, rules}."""
    name = request.get("id", "default-request-id")
    try:
        own = rules.from_dict(request.get("rules") or {})
        finish = request.get("finish")
        found = generate(graph, own, tuple(request["start"]), tuple(finish) if finish else None, float(request.get("bearing", 0)), float(request.get("distance", 0)))
        return sinks.response_frame(found, name).first()["response"]
    except Exception as e:  # noqa: BLE001 - a request that fails must not end the server
        return sinks.error_response(str(e), name)


def serve(graph: Roads, host: str, port: int) -> socketserver.ThreadingTCPServer:
    """A server that answers requests of an 8-byte length and JSON, each in its own thread over the one session."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            (n,) = struct.unpack("=Q", self.rfile.read(8))
            out = answer(graph, json.loads(self.rfile.read(n))).encode()
            self.wfile.write(struct.pack("=Q", len(out)) + out)

    return socketserver.ThreadingTCPServer((host, port), Handler)


def ask(host: str, port: int, request: dict) -> str:
    """A running server's answer to a request."""
    said = json.dumps(request).encode()
    with socket.create_connection((host, port)) as connection, connection.makefile("rb") as back:
        connection.sendall(struct.pack("=Q", len(said)) + said)
        (n,) = struct.unpack("=Q", back.read(8))
        return back.read(n).decode()


def trace_rows(spark: SparkSession, folder: str, name: str, asked: dict[str, str]) -> list[dict]:
    """A page of a trace table as rows. asked: itinerary_id, step_num and page, each if it is wanted."""
    step = asked.get("step_num")
    found = trace.page(trace.read(spark, folder, name), asked.get("itinerary_id"), None if step is None else int(step), int(asked.get("page", 0)))
    return [r.asDict() for r in found.collect()]


def view(spark: SparkSession, folder: str, host: str, port: int) -> http.server.ThreadingHTTPServer:
    """A server of trace pages: GET /steps?itinerary_id=...&step_num=...&page=... and so for each table; / names the tables and
    where the searches were."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802 - the library's name
            at = urllib.parse.urlsplit(self.path)
            asked = {k: v[0] for k, v in urllib.parse.parse_qs(at.query).items()}
            name = at.path.strip("/")
            try:
                if not name:
                    said = {"tables": sorted(trace.FILES), "extent": trace.extent(trace.read(spark, folder, "itineraries")).first().asDict()}
                elif name in trace.FILES:
                    said = trace_rows(spark, folder, name, asked)
                else:
                    raise KeyError(name)
                status = 200
            except (KeyError, ValueError) as e:
                said, status = {"error": str(e)}, 404
            body = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return http.server.ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="roadloom")
    modes = parser.add_subparsers(dest="mode", required=True)
    for name in ("generate-route", "prep-cache", "start-server", "client", "view-trace"):
        p = modes.add_parser(name)
        if name == "view-trace":
            p.add_argument("--trace-dir", required=True)
        elif name != "client":
            p.add_argument("--input", required=True)
            p.add_argument("--cache-dir", required=name == "prep-cache")
        if name == "generate-route":
            p.add_argument("--trace-dir", help="where to write every decision of the searches")
        if name in ("generate-route", "client"):
            p.add_argument("--start", type=coordinates, required=True)
            end = p.add_mutually_exclusive_group(required=True)
            end.add_argument("--finish", type=coordinates)
            end.add_argument("--distance", type=float, help="of a round trip, in metres")
            p.add_argument("--bearing", type=float, default=0.0)
            p.add_argument("--rules")
            p.add_argument("--output")
            if name == "generate-route":
                p.add_argument("--split", action="store_true", help="a GPX file for each route")
        if name in ("start-server", "client", "view-trace"):
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--port", type=int, default=0, required=name == "client")
    modes.add_parser("rule-schema").add_argument("--output")
    args = parser.parse_args(argv)
    if args.mode == "rule-schema":
        text = json.dumps(rules.json_schema(), indent=2)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sys.stdout.write(text + "\n")
        return
    if args.mode == "client":
        own = json.load(open(args.rules, encoding="utf-8")) if args.rules else {}
        text = ask(args.host, args.port, {"id": "default-request-id", "start": args.start, "finish": args.finish, "bearing": args.bearing, "distance": args.distance or 0.0, "rules": own})
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sys.stdout.write(text + "\n")
        return
    spark = SparkSession.builder.appName("roadloom").config("spark.scheduler.mode", "FAIR").getOrCreate()
    if args.mode == "view-trace":
        with view(spark, args.trace_dir, args.host, args.port) as server:
            print(f"listening on {args.host}:{server.server_address[1]}", flush=True)
            server.serve_forever()
        return
    graph = roads(spark, args.input, args.cache_dir)
    if args.mode == "generate-route":
        found = generate(graph, rules.read_rules(args.rules), args.start, args.finish, args.bearing, args.distance or 0.0, args.trace_dir)
        sinks.write(found, args.output, args.split)
    elif args.mode == "start-server":
        with serve(graph, args.host, args.port) as server:
            print(f"listening on {args.host}:{server.server_address[1]}", flush=True)
            server.serve_forever()


if __name__ == "__main__":
    main()
