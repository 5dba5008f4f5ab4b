"""Settings: six sections with defaults and validation; YAML where a parser is there, JSON always."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, fields, is_dataclass

# The names of the settings and their defaults.

@dataclass
class Wal:
    segmentSize: int = 1 << 20
    bufferSize: int = 8
    walFolderPath: str = "./wal"


@dataclass
class BTree:
    minSize: int = 16


@dataclass
class SkipList:
    maxHeight: int = 32


@dataclass
class Memtable:
    maxSize: int = 1024
    structure: str = "SkipList"
    instances: int = 1
    BTree: BTree = field(default_factory=BTree)
    SkipList: SkipList = field(default_factory=SkipList)


@dataclass
class SSTable:
    savePath: str = "./data"
    singleFile: bool = False
    summaryDegree: int = 5
    indexDegree: int = 5
    compression: bool = True
    filterPrecision: float = 0.01
    merkleTreeChunkSize: int = 1024
    compressionFilename: str = "CompressionInfo.bin"


@dataclass
class SizeTiered:
    maxLsmNodesPerLevel: int = 8


@dataclass
class Leveled:
    dataBlockSize: int = 160_000
    firstLevelTotalDataSize: int = 1_000_000
    fanoutSize: int = 10


@dataclass
class LSMTree:
    maxLevel: int = 4
    compactionAlgorithm: str = "Size-Tiered"
    SizeTiered: SizeTiered = field(default_factory=SizeTiered)
    Leveled: Leveled = field(default_factory=Leveled)


@dataclass
class Cache:
    maxSize: int = 1024


@dataclass
class TokenBucket:
    maxTokenSize: int = 1024
    interval: int = 60


@dataclass
class Config:
    WAL: Wal = field(default_factory=Wal)
    Memtable: Memtable = field(default_factory=Memtable)
    SSTable: SSTable = field(default_factory=SSTable)
    LSMTree: LSMTree = field(default_factory=LSMTree)
    Cache: Cache = field(default_factory=Cache)
    TokenBucket: TokenBucket = field(default_factory=TokenBucket)


CHOICES = {"structure": ("SkipList", "HashMap", "BTree"), "compactionAlgorithm": ("Size-Tiered", "Leveled")}


def validate(section, path: str = "") -> None:
    """Raise ValueError for the first setting that is out of range or of another type."""
    for f in fields(section):
        v, at = getattr(section, f.name), f"{path}{f.name}"
        if is_dataclass(v):
            validate(v, at + ".")
        elif f.name in CHOICES:
            if v not in CHOICES[f.name]:
                raise ValueError(f"{at} must be one of {', '.join(CHOICES[f.name])}")
        elif f.name == "filterPrecision":
            if not (isinstance(v, (int, float)) and 0 < v < 1):
                raise ValueError(f"{at} must be between 0 and 1, exclusively")
        elif f.type == "int":
            least = 2 if f.name == "fanoutSize" else 1
            if not isinstance(v, int) or isinstance(v, bool) or v < least:
                raise ValueError(f"{at} must be a whole number of at least {least}")
        elif f.type == "bool" and not isinstance(v, bool) or f.type == "str" and not (isinstance(v, str) and v):
            raise ValueError(f"{at} is not valid")


def _fill(section, values: dict) -> None:
    known = {f.name for f in fields(section)}
    for k, v in (values or {}).items():
        if k not in known:
            continue
        if is_dataclass(getattr(section, k)):
            _fill(getattr(section, k), v)
        else:
            setattr(section, k, v)


def load(path: str) -> Config:
    """The settings of a file over the defaults. An unreadable or invalid file warns and gives the defaults."""
    try:
        with open(path) as f:
            text = f.read()
        try:
            values = json.loads(text)
        except ValueError:
            import yaml

            values = yaml.safe_load(text)
        c = Config()
        _fill(c, values or {})
        validate(c)
        return c
    except Exception as x:
        warnings.warn(f"{path}: {x}; the defaults are used", stacklevel=2)
        return Config()


def save(config: Config, path: str) -> None:
    validate(config)
    with open(path, "w") as f:
        json.dump(asdict(config), f, indent=2)
