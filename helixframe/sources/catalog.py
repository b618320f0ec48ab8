"""Reference catalogs: JSON documents of constants, read once by the driver, with lookups by dotted paths."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..functions import constants as K

_MISSING = object()


class Catalogs:
    """Named JSON documents. A document that is empty or no object is refused."""

    def __init__(self, documents: Mapping[str, dict]):
        for name, doc in documents.items():
            if not isinstance(doc, dict) or not doc:
                raise ValueError(f"catalog {name!r} is empty or no JSON object")
        self.documents = dict(documents)

    @classmethod
    def read(cls, spark: SparkSession, paths: Mapping[str, str]) -> Catalogs:
        """From files, wherever Spark reads them; a catalog is a small file."""
        return cls({name: json.loads(spark.read.text(path, wholetext=True).head()[0]) for name, path in paths.items()})

    @classmethod
    def built_in(cls) -> Catalogs:
        """The engine's own tables in the same form."""
        residues = {r: {"name": v[0], "molecular_weight": v[1], "hydropathy": v[2], "pka": v[3], "helix": v[4], "sheet": v[5], "turn": v[6]} for r, v in K.RESIDUES.items()}
        motifs = {m: {"category": c, "pattern": p} for m, (c, p) in K.MOTIFS.items()}
        databases = {d: {"category": c, "by_id": i, "url": u} for d, (c, i, u) in K.DATABASES.items()}
        return cls({
            "amino_acids": {"amino_acids": residues, "amino_acid_groups": dict(K.GROUPS)},
            "motif_patterns": {"motif_patterns": motifs, "motif_categories": sorted({c for c, _ in K.MOTIFS.values()})},
            "bioinformatics_databases": {"databases": databases, "database_categories": sorted({c for c, _, _ in K.DATABASES.values()})},
            "physicochemical_constants": {"extinction": dict(K.EXTINCTION), "dipeptide_values": dict(K.DIPEPTIDES)},
        })

    def get(self, name: str, path: str = "", default=_MISSING):
        """The value at a dotted path of a catalog; ``default``, or a KeyError without one, where there is none."""
        at = self.documents.get(name, _MISSING)
        for key in filter(None, path.split(".")):
            at = at.get(key, _MISSING) if isinstance(at, dict) else _MISSING
        if at is _MISSING:
            if default is _MISSING:
                raise KeyError(f"{name}.{path}")
            return default
        return at

    def summary(self) -> dict[str, dict[str, int]]:
        """Of each catalog the number of entries in each of its parts."""
        return {name: {part: len(v) for part, v in doc.items() if isinstance(v, (dict, list))} for name, doc in self.documents.items()}
