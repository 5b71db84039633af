"""Media columns: audio features of 8-bit samples, stored as WAV and read back.

Samples are resampled with a polyphase filter, cut into overlapping frames, and turned into log-mel energies. Features are fixed-shape
Arrow tensors: all frames of a clip are dealt into blocks of BLOCK_FRAMES x MELS numbers, the last one padded, each with its time span.
Beside them stand the segments: time spans whose energy passes a high threshold and stays over a low one (hysteresis).

Tensors are stored in Arrow IPC files, a row a block: the tensor in 16-bit floats and its span. A Parquet index names for each clip the file and
its rows there. Files are written under a name of the attempt's own and then renamed, and only those that the index names are read.

Defined cases: null media gives null features; media without samples gives no blocks. Payloads that aren't whole frames of the
format are padded by the writer and the true length travels beside them. Repeated rows keep a row each. Empty tables give
empty results. Other columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import map_texts, named, new_path, positional, slices, table
from millrace.llm.warc import file_system

RATE, UP, DOWN, TAPS = 8000, 2, 3, 32
FRAME, HOP, MELS, BLOCK_FRAMES = 256, 128, 24, 32
HIGH, LOW, MIN_FRAMES = 1.5, 1.0, 3
#: Samples that a worker turns into frames at once; blocks that a batch of a tensor file has, and after how many a new file starts.
CHUNK, BATCH_BLOCKS, FILE_BLOCKS = 1 << 16, 256, 1 << 15
UNIT = 64


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples."""
    pad = b"\0" * (len(samples) % 2)
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples + pad


def unwav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate, found chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        if kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples in the file")


def _lowpass(up: int, down: int) -> np.ndarray:
    n = np.arange(-TAPS, TAPS + 1)
    return np.sinc(n / max(up, down)) * np.hamming(2 * TAPS + 1) / max(up, down) * up


KERNEL = _lowpass(UP, DOWN)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, kernel: np.ndarray | None = None) -> np.ndarray:
    """Polyphase: each of the `up` phases of the filter meets only the samples that it needs; no zero is inserted or thrown away."""
    kernel = KERNEL if kernel is None else kernel
    half, n = len(kernel) // 2, -(-len(x) * up // down)
    k = np.arange(n) * down
    out = np.empty(n)
    for phase in range(up):
        mine = np.flatnonzero(k % up == phase)
        if not len(mine):
            continue
        first = -((half - phase) // up)  # offsets j with |phase - j up| <= half
        offsets = np.arange(first, (half + phase) // up + 1)
        taps = kernel[half + phase - offsets * up]
        padded = np.pad(x, (-offsets[0], offsets[-1] + 1))
        base, step = k[mine[0]] // up, (k[mine[1]] - k[mine[0]]) // up if len(mine) > 1 else 1
        out[mine] = np.lib.stride_tricks.sliding_window_view(padded, len(offsets))[base::step][: len(mine)] @ taps  # a strided product
    return out


def mel_bank(rate: float, n_fft: int = FRAME, mels: int = MELS) -> np.ndarray:
    hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(n_fft, 1 / rate)
    rise, fall = (bins - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None], (hz[2:, None] - bins) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32).T


BANK, WINDOW = mel_bank(RATE * UP / DOWN), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mels(x: np.ndarray) -> np.ndarray:
    """Frames x mels; the last frame is padded with silence."""
    x = np.pad(x.astype(np.float32), (0, max(0, FRAME - len(x)) + (-max(len(x) - FRAME, 0)) % HOP))
    frames, out = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], []
    for at in range(0, len(frames), CHUNK // FRAME):
        power = np.abs(np.fft.rfft(frames[at : at + CHUNK // FRAME] * WINDOW, axis=1)) ** 2
        out.append(np.log(power.astype(np.float32) @ BANK + 1e-6))
    return np.concatenate(out)


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW, least: int = MIN_FRAMES) -> list[tuple[int, int]]:
    """Spans of frames over the low threshold that reach the high one; thresholds are in deviations over the mean minus one."""
    if not len(energy):
        return []
    level = (energy - energy.mean()) / (energy.std() + 1e-9) + 1
    over = np.r_[False, level >= low, False].astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(over) == 1), np.flatnonzero(np.diff(over) == -1)
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= least and level[a:b].max() >= high]


def features(media: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Blocks x BLOCK_FRAMES x MELS of all frames, each block's time span in seconds, and the segments' time spans."""
    samples, rate = unwav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    if not len(x):
        return np.zeros((0, BLOCK_FRAMES, MELS), np.float32), [], []
    mels = log_mels(resample(x))
    step, n = HOP * DOWN / UP / rate, len(mels)
    blocks = np.pad(mels, ((0, -n % BLOCK_FRAMES), (0, 0))).reshape(-1, BLOCK_FRAMES, MELS)
    seconds = lambda a, b: (round(a * step, 6), round(b * step, 6))
    return blocks, [seconds(at, min(n, at + BLOCK_FRAMES)) for at in range(0, n, BLOCK_FRAMES)], [seconds(*ab) for ab in segments(mels.mean(axis=1))]


def write_media(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores each text's UTF-8 bytes, padded to a positive multiple of 64, as a WAV file in a column; the table that is at path then."""

    def compute(texts: list) -> dict:
        media, sizes = [], []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            media.append(wav(raw + b"\0" * ((-len(raw)) % UNIT or (0 if raw else UNIT))))
        return {"media": media, "n_bytes": sizes}

    made = map_texts(df, text, "media binary, n_bytes bigint", compute, list(keep))
    made.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


TENSOR = pa.fixed_shape_tensor(pa.float16(), (BLOCK_FRAMES, MELS))


def as_tensors(blocks: np.ndarray) -> pa.ExtensionArray:
    """Blocks as Arrow's fixed-shape tensor type."""
    flat = pa.array(np.ascontiguousarray(blocks, np.float16).reshape(-1))
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, BLOCK_FRAMES * MELS))


class TensorWriter:
    """Arrow IPC files of (tensor, start, end) in a folder; done() gives a file its name once it is whole."""

    def __init__(self, path: str):
        self.fs, self.root = file_system(path)
        self.fs.create_dir(self.root, recursive=True)
        self.schema = pa.schema([("tensor", TENSOR), ("start", pa.float64()), ("end", pa.float64())])
        self.held: list[tuple[np.ndarray, list]] = []
        self.rows, self.kept, self.writer = 0, 0, None

    def add(self, blocks: np.ndarray, spans: list) -> tuple[str, int]:
        """The file and the first row that these blocks get."""
        if self.writer is None:
            self.file, self.attempt, self.rows, self.kept = f"part-{uuid.uuid4().hex}.arrow", f"{self.root}/.{uuid.uuid4().hex}", 0, 0
            self.out = self.fs.open_output_stream(self.attempt)
            self.writer = pa.ipc.new_file(self.out, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        at = self.rows
        self.held.append((blocks, spans))
        self.rows, self.kept = self.rows + len(blocks), self.kept + len(blocks)
        if self.kept >= BATCH_BLOCKS:
            self.flush()
        return self.file, at

    def flush(self) -> None:
        blocks, spans = np.concatenate([b for b, _ in self.held]), [s for _, part in self.held for s in part]
        whole = pa.RecordBatch.from_arrays([as_tensors(blocks), pa.array([a for a, _ in spans], pa.float64()), pa.array([b for _, b in spans], pa.float64())], schema=self.schema)
        for at in range(0, max(1, len(blocks)), BATCH_BLOCKS):
            self.writer.write_batch(whole.slice(at, BATCH_BLOCKS))
        self.held, self.kept = [], 0

    def done(self) -> None:
        if self.writer is not None:
            if self.held:
                self.flush()
            self.writer.close()
            self.out.close()
            self.fs.move(self.attempt, f"{self.root}/{self.file}")
            self.writer = None


class TensorReader:
    """Rows of the tensor files, one batch of a file held at a time."""

    def __init__(self, path: str):
        self.fs, self.root = file_system(path)
        self.name, self.source = None, None

    def rows(self, file: str, at: int, n: int) -> tuple[np.ndarray, list]:
        if file != self.name:
            self.close()
            self.source = self.fs.open_input_file(f"{self.root}/{file}")
            self.reader, self.name, self.number, self.first, self.batch = pa.ipc.open_file(self.source), file, -1, 0, None
        blocks, spans = [np.zeros((0, BLOCK_FRAMES, MELS), np.float16)], []
        if self.batch is not None and at < self.first:
            self.number, self.first, self.batch = -1, 0, None
        while n:
            while self.batch is None or at >= self.first + self.batch.num_rows:
                self.first += self.batch.num_rows if self.batch is not None else 0
                self.number += 1
                self.batch = self.reader.get_batch(self.number)
            part = self.batch.slice(at - self.first, n)
            blocks.append(part.column(0).to_numpy_ndarray())
            spans += zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
            at, n = at + part.num_rows, n - part.num_rows
        return np.concatenate(blocks), spans

    def close(self) -> None:
        if self.source is not None:
            self.source.close()


TIMES = "array<struct<start: double, end: double>>"


def write_features(df: DataFrame, path: str, media: str = "media", keep: tuple[str, ...] = ("doc_id",), more: tuple[str, Callable[[bytes | None], tuple]] | None = None) -> DataFrame:
    """Writes the tensors of all clips to files in path/tensors; the index at path/index: keep, file, first, blocks, segments, and what `more`, (DDL, function), makes of the media."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    extra = list(StructType.fromDDL(more[0])) if more else []
    made = list(StructType.fromDDL(f"file string, first bigint, blocks int, segments {TIMES}")) + extra
    chosen = positional(df.select(*map(named, keep), named(media)))
    schema = StructType(list(chosen.schema.fields[:-1]) + [StructField(f"m{k}", f.dataType) for k, f in enumerate(made)])
    arrow, many = to_arrow_schema(schema, prefers_large_types=False), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, waiting = TensorWriter(f"{path}/tensors"), []
        for part in slices(batches, 64):
            rows = []
            for m in part.column(many).to_pylist():
                if m is None:
                    rows.append((None, None, None, None, *(more[1](m) if more else ())))
                    continue
                blocks, spans, segments_ = features(m)
                file, at = writer.add(blocks, spans)
                rows.append((file, at, len(blocks), [{"start": a, "end": b} for a, b in segments_], *(more[1](m) if more else ())))
            columns = [pa.array(c, arrow.field(many + k).type) for k, c in enumerate(zip(*rows, strict=True))]
            waiting.append(pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow.field(i).type) for i in range(many)), *columns], schema=arrow))
            if writer.rows >= FILE_BLOCKS:
                writer.done()
                yield from waiting
                waiting = []
        writer.done()  # rows are given out only once their files are whole
        yield from waiting

    index = chosen.mapInArrow(run, schema).toDF(*keep, *(f.name for f in made))
    index.write.parquet(f"{path}/index")
    return df.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def read_features(index: DataFrame, path: str, compute: Callable[[np.ndarray, list], object], kind: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and value: what compute makes of each clip's tensors and their spans, read from the files; null where the clip has no features."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    chosen = positional(index.select(*map(named, keep), "file", "first", "blocks"))
    schema = StructType(list(chosen.schema.fields[:-3]) + [StructField("value", StructType.fromDDL(f"v {kind}")[0].dataType)])
    arrow, many = to_arrow_schema(schema, prefers_large_types=False), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TensorReader(f"{path}/tensors")
        for part in slices(batches):
            where = zip(*(part.column(many + k).to_pylist() for k in range(3)), strict=True)
            values = [None if file is None else compute(*reader.rows(file, at, n)) for file, at, n in where]
            yield pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow.field(i).type) for i in range(many)), pa.array(values, arrow.field(many).type)], schema=arrow)
        reader.close()

    return chosen.mapInArrow(run, schema).toDF(*keep, "value")


def audio_features(df: DataFrame, path: str, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, tensors (blocks of BLOCK_FRAMES x MELS numbers in row order), spans (one a block) and segments, by way of the stored tensors."""
    index = write_features(df, path, media, keep)

    def value(blocks: np.ndarray, spans: list) -> dict:
        return {"tensors": blocks.astype(np.float32).reshape(len(blocks), -1).tolist(), "spans": [{"start": a, "end": b} for a, b in spans]}

    names = [f"k{k}" for k in range(len(keep))]
    read = read_features(index.toDF(*names, *index.columns[len(keep):]), path, value, f"struct<tensors: array<array<float>>, spans: {TIMES}>", (*names, "segments"))
    return read.select(*names, "value.tensors", "value.spans", "segments").toDF(*keep, "tensors", "spans", "segments")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores, reads back, and digests: feature is the numbers and times of blocks and of segments, and a hash of the tensors that are read back."""
    path = new_path(spark, "media")
    stored = write_media(table(spark, sf_dir, "documents"), f"{path}/wav")

    def facts(m: bytes) -> tuple:
        payload = unwav(m)[0]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest()

    schema = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
    index = write_features(stored, path, keep=("doc_id", "n_bytes"), more=(schema, facts))

    def digest(blocks: np.ndarray, spans: list) -> str:
        return f"{len(spans)}:{sum(b - a for a, b in spans):.3f}:{hashlib.sha256(blocks.tobytes()).hexdigest()[:16]}"

    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    read = read_features(index, path, digest, "string", (*columns, "segments"))
    times = F.aggregate("segments", F.lit(0.0), lambda t, x: t + x["end"] - x["start"])
    return read.select(*columns, F.concat_ws(":", "value", F.size("segments"), F.round(times, 3).cast("decimal(18,3)").cast("string")).alias("feature"))
