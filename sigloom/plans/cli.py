"""Command line: ``python -m sigloom.plans.cli INPUT_TYPE OUTPUT INPUT [options]``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from ..sources.catalog import read_inputs, seed_of
from ..sources.channels import STRANDS
from ..sources.genome import read_fasta
from .extract import Parameters, extract, write_text
from .report import genome_build

#: What the command's yes-or-no options accept.
YES, NO = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def flag(text: str) -> bool:
    low = text.lower()
    if low in YES:
        return True
    if low in NO:
        return False
    raise argparse.ArgumentTypeError("a yes or no is expected")


#: What the command line has as defaults of its own.
DEFAULTS = {"maximum_signatures": 10}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Extract latent signatures from counts")
    for name in ("input_type", "output", "input_data"):
        p.add_argument(name)
    p.add_argument("--seeds", default="random")
    p.add_argument("--context_type", default="default", help="contexts of variants: SBS96, DBS78, ID83, with commas")
    p.add_argument("--flanks", help="Parquet table (chrom, pos, before, after) of the bases beside the variants")
    p.add_argument("--reference_genome", default="GRCh37", help="the reference's build; with --volume its sequences are VOLUME/BUILD.fa")
    p.add_argument("--opportunity_genome", default="GRCh37", help="the build of the known signatures below --volume")
    p.add_argument("--cosmic_version", type=float, default=3.4, help="the version of the known signatures below --volume")
    p.add_argument("--volume", help="folder of reference files: BUILD.fa, BUILD_transcripts.parquet, signatures/BUILD_vVERSION.parquet")
    p.add_argument("--reference_sequence", help="FASTA files of the reference, instead of those below --volume")
    p.add_argument("--transcripts", help="Parquet table (chrom, start, end, strand) of what is transcribed, for contexts with strands")
    p.add_argument("--collapse_to_SBS96", type=flag, default=True, help="decompose finer contexts of substitutions as SBS96")
    p.add_argument("--known", help="Parquet table (channel, signature, weight) to decompose the suggested solution into")
    p.add_argument("--select", type=int, help="the rank to suggest, whatever the rule says")
    for name, what in (("get_all_signature_matrices", "write every replicate's factors"), ("export_probabilities", "write the suggested solution's probabilities"), ("export_text", "write the suggested solution as tab-separated matrices, too"), ("stop_after_extraction", "suggest a rank, but decompose nothing")):
        p.add_argument(f"--{name}", type=flag, default=False, help=what)
    for f in fields(Parameters):
        if f.name != "seed":
            kind = type(f.default)
            p.add_argument(f"--{f.name}", type=flag if kind is bool else kind, default=DEFAULTS.get(f.name, f.default))
    return p


OWN = (
    "input_type", "output", "input_data", "seeds", "context_type", "flanks", "known", "select", "get_all_signature_matrices", "export_probabilities", "export_text", "stop_after_extraction",
    "reference_genome", "opportunity_genome", "cosmic_version", "volume", "reference_sequence", "transcripts", "collapse_to_SBS96",
)


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    spark = SparkSession.builder.appName("sigloom").getOrCreate()
    kind, out, data, seeds, contexts, flanks, known, select, every, probabilities, as_text, stop, build, opportunity, version, volume, sequence, transcripts, coarse = (args.pop(k) for k in OWN)
    p = Parameters(seed=seed_of(spark, seeds), **args)
    table = lambda path: spark.read.parquet(path) if path else None
    build, note = genome_build(build)
    if note:
        print(note)
    if volume:
        sequence = sequence or f"{volume}/{build}.fa"
        transcripts = transcripts or (f"{volume}/{build}_transcripts.parquet" if any(STRANDS.get(c) for c in contexts.upper().split(",")) else None)
        known = known or f"{volume}/signatures/{genome_build(opportunity)[0]}_v{version:g}.parquet"
    known = None if stop else table(known)
    parts = read_fasta(spark, sequence) if sequence and kind.lower() == "vcf" and not flanks else None
    for name, catalog in read_inputs(spark, kind, data, contexts, table(flanks), parts, table(transcripts)).items():
        result = extract(catalog, p, select)
        result.write(f"{out}/{name}" if name else out, known, every, probabilities, coarse)
        if as_text:
            write_text(result, f"{out}/{name}/text" if name else f"{out}/text")
        print(f"{name or result.context}: {result.chosen} signatures")
        result.release()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
