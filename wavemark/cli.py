"""python -m wavemark.cli index|query|info: an index of WAV files from the shell."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import WaveError
from .plans import as_queries, fingerprint
from .sources import folder, store
from .sources.wav import failed, good, read_wavs


#: What scripts read from this command's output.
NO_DATABASE = 'Database file "{}" does not exist.'
MATCH = "Match found: {}\nScore: {}\nOffset: {:.2f}s"
NO_MATCH = "No match found."
INFO = 'Database: "{}"\nTracks indexed: {}\nTotal hashes: {}'


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="wavemark", description="Fingerprints audio files and finds clips")
    parser.add_argument("-V", "--version", action="version", version="wavemark 1.0")
    parser.add_argument("-v", "--verbose", action="store_true", help="print counts and times")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about, value in (("index", "add WAV files to a database", "INPUT_PATH"), ("query", "find a clip in a database", "FILE"), ("info", "describe a database", None)):
        command = commands.add_parser(name, help=about)
        command.add_argument("-d", "--db", required=True, help="folder of the database")
        command.add_argument("-v", "--verbose", action="store_true", default=argparse.SUPPRESS)
        if value:
            command.add_argument("input", metavar=value)
    return parser


def index(spark: SparkSession, db: str, path: str, verbose: bool) -> None:
    """Files that the database has not seen, in one job; one that fails is reported and the others go on.
    Running it again decodes only what is new or changed."""
    change = folder.update(spark, db, path)
    print(f"{change.fresh} files to index", flush=True)
    if change.listed > change.fresh:
        print(f"{change.listed - change.fresh} files known")
    for row in change.failed.orderBy("track_name", "path").toLocalIterator():
        print(f"skipped {row['track_name']}: {row['error']}")
    if verbose:
        for row in change.tracks.orderBy("track_name").toLocalIterator():
            print(f"{row['track_name']}: {row['hashes']} hashes")
    print(f"{change.made} of {change.fresh} files fingerprinted", flush=True)
    print(f"saved to {db}")


def query(spark: SparkSession, db: str, path: str, verbose: bool) -> None:
    """Asks with one file of any name; a bad file is an error here, not an empty answer."""
    if not store.Store(spark, db).exists():
        raise SystemExit(f"Error: {NO_DATABASE.format(db)} Index first.")
    started = time.time()
    signals = read_wavs(spark, path).persist()
    for row in failed(signals).toLocalIterator():
        raise WaveError(f"{row['path']}: {row['error']}")
    prints = fingerprint(good(signals)).persist()
    n, made = prints.count(), time.time()
    found = store.query_store(spark, db, as_queries(prints).withColumn("query_id", F.lit("clip"))).first()
    if verbose:
        print(f"{n} hashes in {made - started:.3f} s, looked up in {time.time() - made:.3f} s")
    print(MATCH.format(found["track_id"], found["score"], found["offset_secs"]) if found else NO_MATCH)


def info(spark: SparkSession, db: str) -> None:
    if not store.Store(spark, db).exists():
        raise SystemExit(f"Error: {NO_DATABASE.format(db)}")
    held = store.load(spark, db)
    print(INFO.format(db, held.track_count(), held.hash_count()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("wavemark").getOrCreate()
    try:
        if args.command == "index":
            index(spark, args.db, args.input, args.verbose)
        elif args.command == "query":
            query(spark, args.db, args.input, args.verbose)
        else:
            info(spark, args.db)
    except WaveError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
