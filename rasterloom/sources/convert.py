"""Conversion of single files from the command line: python -m rasterloom.sources.convert IN -o OUT [-lossy] [-quality Q].

Formats go by content when reading and by extension when writing: .webp and .png. Flags may stand anywhere; -x and --x are the same;
-o=OUT, -lossy=false and -quality=80 are understood; after -- everything is a file name.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from ..codecs import image
from .png import SIGNATURE, read_png, write_png

QUALITY = 75.0
TRUE, FALSE = {"1", "t", "true"}, {"0", "f", "false"}


@dataclass
class Job:
    source: str
    target: str
    lossy: bool = False
    quality: float = QUALITY


def parse(args: list[str]) -> Job:
    rest, own, names = list(args), {"o": None, "lossy": "false", "quality": str(QUALITY)}, []
    while rest:
        a = rest.pop(0)
        if a == "--":
            names += rest
            break
        if not a.startswith("-") or a == "-":
            names.append(a)
            continue
        flag, eq, value = a.lstrip("-").partition("=")
        if flag not in own:
            raise ValueError(f"unknown flag {a}")
        if not eq:
            if flag == "lossy":
                value = "true"
            elif rest:
                value = rest.pop(0)
            else:
                raise ValueError(f"{a} needs a value")
        own[flag] = value
    if own["o"] in (None, ""):
        raise ValueError("-o OUT is required")
    if len(names) != 1:
        raise ValueError("exactly one input file is required")
    if own["lossy"].lower() not in TRUE | FALSE:
        raise ValueError("-lossy takes true or false")
    return Job(names[0], own["o"], own["lossy"].lower() in TRUE, float(own["quality"]))


def convert(job: Job) -> None:
    with open(job.source, "rb") as f:
        data = f.read()
    pixels = read_png(data) if data[:8] == SIGNATURE else image.decode(data)
    kind = os.path.splitext(job.target)[1].lower()
    if kind == ".webp":
        out = image.encode(pixels, job.lossy, job.quality)
    elif kind == ".png":
        out = write_png(pixels)
    else:
        raise ValueError(f"cannot write {kind or 'a file without an extension'}; .webp and .png are written")
    with open(job.target, "wb") as f:
        f.write(out)


def main(args: list[str] | None = None) -> int:
    try:
        convert(parse(sys.argv[1:] if args is None else args))
    except (ValueError, OSError) as e:
        print(f"{e}\n{__doc__.splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
