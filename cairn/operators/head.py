"""Linear classification heads fitted by passes over a table of feature vectors: one head, or those of all folds at once."""

from __future__ import annotations

import base64
import json
import math
import secrets
from dataclasses import asdict, dataclass, field
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import balance, metrics, scoring, threshold
from cairn.operators.losses import CLASSIFICATION
from cairn.sources import checkpoints

#: What a row is to a fold.
TRAIN, VAL, TEST, NONE = range(4)
SPLITS = {"train": TRAIN, "val": VAL, "test": TEST}
STATE = 9
#: What passes return: sums (at >= 0, value) and counts of scores (at = -1, prob, p, n), by fold and phase.
PARTS = "fold int, phase int, at int, prob float, value double, p long, n long"
#: Batches of fewer rows than two lanes' are walked by one task at a time, larger ones by several at once.
LANE_ROWS = 4096
#: Rows that a task walks before it hands the state on, which takes a second.
TURN_ROWS = 1 << 20
MEASURES = ("recall", "specificity", "f1", "auc")


@dataclass(frozen=True)
class Settings:
    """How heads are fitted. `batch_size` None: a step takes all rows; else batches in the order of `strategy`."""

    loss: str = "weighted_ce"
    class_weights: tuple[float, ...] | None = (0.6, 1.0)
    epochs: int = 30
    lr: float = 1e-2
    weight_decay: float = 1e-4
    dropout: float = 0.0
    gamma: float = 2.0
    patience: int = 8
    metric: str = "val_recall"
    seed: int = 42
    batch_size: int | None = None
    strategy: str = "none"
    input_channels: int = 1
    use_rgb: bool = False

    @property
    def kind(self) -> str:
        if self.loss.lower() not in CLASSIFICATION:
            raise ValueError(f"unknown loss: {self.loss}")
        return CLASSIFICATION[self.loss.lower()]

    @property
    def weights(self) -> np.ndarray:
        return np.ones(2) if self.kind == "ce" or self.class_weights is None else np.asarray(self.class_weights, float)


@dataclass
class Head:
    """A head being fitted: its weights (two rows of coefficients, then two intercepts), AdamW's moments, and how it fares."""

    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    taken: int = 0
    best: float = -math.inf
    waited: int = 0
    history: list = field(default_factory=list)
    model: dict | None = None

    def step(self, slope: np.ndarray, s: Settings) -> None:
        self.taken += 1
        self.first, self.second = 0.9 * self.first + 0.1 * slope, 0.999 * self.second + 0.001 * slope**2
        move = self.first / (1 - 0.9**self.taken) / (np.sqrt(self.second / (1 - 0.999**self.taken)) + 1e-8)
        self.theta = self.theta * (1 - s.lr * s.weight_decay) - s.lr * move

    def numbers(self) -> np.ndarray:
        return np.concatenate([self.theta, self.first, self.second, [self.taken]])

    @classmethod
    def of(cls, numbers: np.ndarray) -> Head:
        theta, first, second = np.split(numbers[:-1], 3)
        return cls(theta, first, second, int(numbers[-1]))

    def told(self, row: dict, s: Settings) -> bool:
        """Takes in an epoch's row; True if it is the best so far."""
        self.history.append(row)
        reached = row.get(s.metric, math.nan)
        reached = -row["val_loss"] if math.isnan(reached) else reached
        if reached > self.best:
            self.best, self.waited, self.model = reached, 0, model_of(self.theta, row["epoch"], reached, s)
            return True
        self.waited += 1
        return False


def model_of(theta: np.ndarray, epoch: int, best: float, s: Settings) -> dict:
    coef = theta[:-2].reshape(2, -1)
    return {
        "coef": coef.tolist(), "intercept": theta[-2:].tolist(), "epoch": epoch, "best_score": best, "input_channels": s.input_channels, "use_rgb": s.use_rgb
    }


def row_losses(logits: np.ndarray, y: np.ndarray, kind: str, weights: np.ndarray, gamma: float):
    """(loss, weight, gradient by logits) of each row; the loss isn't yet divided by the weights' sum."""
    shifted = logits - logits.max(axis=1, keepdims=True)
    logp = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
    probs, at = np.exp(logp), np.arange(len(y))
    step = probs.copy()
    step[at, y] -= 1
    w = weights[y]
    ce = -logp[at, y] * w
    if kind != "focal":
        return ce, w, step * w[:, None]
    rest = 1 - np.exp(-ce)
    slope = gamma * rest ** max(gamma - 1, 0) * np.exp(-ce) * ce + rest**gamma if gamma else np.ones_like(ce)
    return rest**gamma * ce, np.ones_like(ce), slope[:, None] * step * w[:, None]


def sums_of(x: np.ndarray, y: np.ndarray, theta: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(sums of loss, weight and gradient, scores of class 1 as float32) of some rows under one head."""
    logits = x @ theta[:-2].reshape(2, -1).T + theta[-2:]
    loss, w, step = row_losses(logits, y, s.kind, s.weights, s.gamma)
    with np.errstate(over="ignore"):
        prob = 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))
    return np.concatenate([[loss.sum(), w.sum()], (step.T @ x).ravel(), step.sum(axis=0)]), prob.astype(np.float32)


def dropped(x: np.ndarray, ids: np.ndarray, keep: float, seed: int) -> np.ndarray:
    """Features left out by hash of (seed, id, place), the others scaled up."""
    if keep >= 1:
        return x
    place = ids.astype(np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(x.shape[1], dtype=np.uint64) + np.uint64(seed)
    place = (place ^ (place >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x * ((place >> np.uint64(11)) / float(1 << 53) < keep) / keep


def arrays(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch["features"].flatten().to_numpy(zero_copy_only=False)
    if len(x) != len(batch) * dim:
        raise ValueError(f"features must have {dim} numbers in every row")
    return x.reshape(-1, dim).astype(float), batch["y"].to_numpy().astype(int), batch["id"].to_numpy()


def part(fold: int, phase: int, at=None, value=None, prob=None, y=None) -> pa.RecordBatch:
    """Rows of PARTS: sums with their places, or how many rows of each class have a score."""
    if prob is None:
        n = len(value)
        columns = [pa.array(np.asarray(at, np.int32)), pa.nulls(n, pa.float32()), pa.array(np.asarray(value, float)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
    else:
        values, kind = np.unique(prob, return_inverse=True)
        n, ones = len(values), np.bincount(kind, y, len(values)).astype(np.int64)
        zeros = np.bincount(kind, minlength=n) - ones
        columns = [pa.array(np.full(n, -1, np.int32)), pa.array(values), pa.nulls(n, pa.float64()), pa.array(ones), pa.array(zeros)]
    both = [pa.array(np.full(n, k, np.int32)) for k in (fold, phase)]
    return pa.RecordBatch.from_arrays([*both, *columns], names=["fold", "phase", "at", "prob", "value", "p", "n"])


def passed(rows: DataFrame, heads: dict[int, np.ndarray], dim: int, s: Settings, epoch: int = 0, phases=(TRAIN, VAL)) -> DataFrame:
    """PARTS of one pass over all rows: each row feeds every head it trains or tests. A task adds its rows up first."""

    def run(batches):
        sums = {}
        for batch in batches:
            x, y, ids = arrays(batch, dim)
            roles = batch["splits"].flatten().to_numpy().reshape(len(batch), -1)
            fed = {p: dropped(x, ids, 1 - s.dropout, s.seed + epoch) if p == TRAIN else x for p in phases}
            for fold, theta in heads.items():
                for phase in phases:
                    own = roles[:, fold] == phase
                    if own.any():
                        added, prob = sums_of(fed[phase][own], y[own], theta, s)
                        added = added if phase == TRAIN else added[:2]
                        sums[fold, phase] = sums.get((fold, phase), 0) + added
                        yield part(fold, phase, prob=prob, y=y[own])
        for (fold, phase), value in sums.items():
            yield part(fold, phase, np.arange(len(value)), value)

    return rows.select("id", "features", "y", "splits").mapInArrow(run, PARTS)


def steps_of(batches, dim: int):
    """(fold, batch, x, y, ids) of the rows of each step, in the order they come; a step may span batches of Arrow."""
    key, held = None, []

    def joined():
        return *key, *(np.concatenate(c) for c in zip(*held, strict=True))

    for rows in batches:
        x, y, ids = arrays(rows, dim)
        keys = np.stack([rows["fold"].to_numpy(), rows["batch"].to_numpy()])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(y)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(keys[:, lo].tolist()) if hi > lo else key
            if own != key and held:
                yield joined()
                held = []
            key = own
            held.append((x[lo:hi], y[lo:hi], ids[lo:hi]))
    if held:
        yield joined()


class Tally:
    """Scores of an epoch's steps, given out some thousands at a time."""

    def __init__(self):
        self.held = {}

    def add(self, fold: int, prob: np.ndarray, y: np.ndarray):
        own = self.held.setdefault(fold, [])
        own.append((prob, y))
        if sum(len(p) for p, _ in own) > 1 << 16 or len(own) > 1 << 10:
            yield from self.flush(fold)

    def flush(self, *folds: int):
        for fold in folds or list(self.held):
            if own := self.held.pop(fold, None):
                yield part(fold, TRAIN, prob=np.concatenate([p for p, _ in own]), y=np.concatenate([y for _, y in own]))


def pack(numbers: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(numbers, float).tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text))


class Lanes:
    """Adds up arrays of all tasks of a barrier stage, again and again: the first task collects and answers.

    Its address and a key go round once by the stage's own exchange, which takes a second; the arrays then go over a
    connection a task. Sums are in the order of tasks. A connection that breaks fails the task, and so the stage.
    """

    def __init__(self, context: BarrierTaskContext):
        self.first, hosts = context.partitionId() == 0, [info.address.rsplit(":", 1)[0] for info in context.getTaskInfos()]
        key = secrets.token_bytes(32)
        listener = Listener((hosts[0], 0), backlog=len(hosts), authkey=key) if self.first else None
        said = context.allGather(json.dumps([*listener.address, key.hex()]) if self.first else "")
        if self.first:
            links = {}
            while len(links) < len(hosts) - 1:
                link = listener.accept()
                links[link.recv()] = link
            listener.close()
            self.links = [links[i] for i in sorted(links)]
        else:
            host, port, key = json.loads(said[0])
            self.links = [Client((host, port), authkey=bytes.fromhex(key))]
            self.links[0].send(context.partitionId())

    def total(self, own: np.ndarray) -> np.ndarray:
        if not self.first:
            self.links[0].send_bytes(own.tobytes())
            return np.frombuffer(self.links[0].recv_bytes())
        for link in self.links:
            own = own + np.frombuffer(link.recv_bytes())
        for link in self.links:
            link.send_bytes(own.tobytes())
        return own

    def __enter__(self) -> Lanes:
        return self

    def __exit__(self, *_) -> None:
        for link in self.links:
            link.close()


def slots(rows: DataFrame) -> int:
    """Tasks that can run at the same time; a barrier stage takes no more."""
    return rows.sparkSession.sparkContext.defaultParallelism


def walked(rows: DataFrame, heads: dict[int, Head], steps: dict[int, int], dim: int, s: Settings, epoch: int) -> DataFrame:
    """PARTS of an epoch of mini-batches of all heads in one barrier stage: the scores before each step, and each head's new
    state (phase STATE), with the sum of its batches' losses.

    The rows are joined to their places once, laid out by place and read once. Steps follow one another, so batches of few rows are walked by
    one task at a time for each head: tasks hold consecutive batches and hand the state on by an exchange a task (folds
    run side by side). Batches of 2 * LANE_ROWS rows and more are cut into lanes: every task has a share of each batch
    and the shares' sums are exchanged each step (`Lanes`). A task holds a step's rows and a batch of Arrow, no more. A
    lost task starts the stage anew, from the same state.
    """
    live, size = sorted(f for f in heads if steps[f]), s.batch_size
    weights = list(s.class_weights) if s.class_weights is not None else None
    orders = None
    for f in live:
        ids = rows.where(F.col("splits")[f] == TRAIN).select("id", F.col("y").alias("label"))
        order = balance.training_order(ids, "id", s.strategy, weights, s.seed, epoch).select(F.lit(f).alias("fold"), "draw", "id")
        orders = order if orders is None else orders.union(order)
    places = slots(rows)
    lanes = max(1, min(places, size // LANE_ROWS))
    groups = min(len(live), places)
    turns = max(1, min(places // groups, -(-max(steps[f] for f in live) * size // TURN_ROWS)))
    per_fold = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("nth") + 1)
    placed = orders.withColumn("batch", F.floor(F.col("draw") / size)).withColumn("nth", F.array_position(F.array(*map(F.lit, live)), F.col("fold")).cast("int") - 1)
    placed = placed.where(F.col("batch") < per_fold([steps[f] for f in live]))
    if lanes > 1:
        to, by, tasks = F.floor(F.col("draw") % size * lanes / size), ("batch", "fold", "draw"), lanes
    else:
        turn = F.floor(F.col("batch") * turns / per_fold([steps[f] for f in live]))
        to, by, tasks = turn * groups + F.col("nth") % groups, ("fold", "draw"), turns * groups
    fed = placed.withColumn("to", to.cast("int")).join(rows.where(F.array_contains("splits", TRAIN)).select("id", "features", "y"), "id")
    dealt = fed.repartitionById(tasks, "to").sortWithinPartitions(*by).select("fold", "batch", "id", "features", "y")
    start = {f: heads[f].numbers() for f in live}

    def ended(states: dict[int, Head], lost: dict[int, float]):
        for f, head in states.items():
            value = np.append(head.numbers(), lost[f])
            yield part(f, STATE, np.arange(len(value)), value)

    def relay(batches):
        context, tally = BarrierTaskContext.get(), Tally()
        mine, group = divmod(context.partitionId(), groups)
        own = [f for nth, f in enumerate(live) if nth % groups == group]
        states = {f: (Head.of(start[f]), 0.0) for f in own}
        for now in range(turns):
            if now == mine:
                for f, _, x, y, ids in steps_of(batches, dim):
                    head, lost = states[f]
                    sums, prob = sums_of(dropped(x, ids, 1 - s.dropout, s.seed + epoch), y, head.theta, s)
                    head.step(sums[2:] / max(sums[1], 1e-300), s)
                    states[f] = head, lost + sums[0] / max(sums[1], 1e-300)
                    yield from tally.add(f, prob, y)
            if turns == 1:
                break
            said = json.dumps({f: pack(np.append(h.numbers(), lost)) for f, (h, lost) in states.items()}) if now == mine else "{}"
            for text in context.allGather(said):
                for f, numbers in json.loads(text).items():
                    if int(f) in states:
                        states[int(f)] = Head.of(unpack(numbers)[:-1]), float(unpack(numbers)[-1])
        yield from tally.flush()
        if mine == turns - 1:
            yield from ended({f: h for f, (h, _) in states.items()}, {f: lost for f, (_, lost) in states.items()})

    def together(batches):
        context, tally = BarrierTaskContext.get(), Tally()
        states, lost = {f: Head.of(start[f]) for f in live}, dict.fromkeys(live, 0.0)
        ahead = steps_of(batches, dim)
        step = next(ahead, None)
        with Lanes(context) as others:
            for number in range(max(steps[f] for f in live)):
                sums = {f: np.zeros(2 + len(states[f].theta)) for f in live if number < steps[f]}
                while step is not None and step[1] == number:
                    f, _, x, y, ids = step
                    sums[f], prob = sums_of(dropped(x, ids, 1 - s.dropout, s.seed + epoch), y, states[f].theta, s)
                    yield from tally.add(f, prob, y)
                    step = next(ahead, None)
                whole = others.total(np.concatenate(list(sums.values())))
                for f, own in zip(sums, np.split(whole, len(sums)), strict=True):
                    states[f].step(own[2:] / max(own[1], 1e-300), s)
                    lost[f] += own[0] / max(own[1], 1e-300)
        yield from tally.flush()
        if context.partitionId() == 0:
            yield from ended(states, lost)

    return dealt.mapInArrow(together if lanes > 1 else relay, PARTS, barrier=True)


def gathered(parts: DataFrame) -> tuple[dict, dict]:
    """Sums by (fold, phase), as large as the models, and the metrics at 0.5 by (fold, phase). The pass runs once."""
    added = parts.groupBy("fold", "phase", "at", "prob").agg(F.sum("value").alias("value"), F.sum("p").alias("p"), F.sum("n").alias("n")).persist()
    try:
        places = {}
        for r in added.where("at >= 0").select("fold", "phase", "at", "value").toLocalIterator():
            places.setdefault((r["fold"], r["phase"]), {})[r["at"]] = r["value"]
        counted = added.where("at < 0").select("fold", "phase", "prob", "p", "n")
        found = metrics.at_level(metrics.summary(counted, {"x": 0.5}, ("fold", "phase")), "x").collect()
    finally:
        added.unpersist()
    sums = {key: np.array([own[i] for i in range(len(own))]) for key, own in places.items()}
    return sums, {(r["fold"], r["phase"]): {m: float(r[m]) for m in MEASURES} for r in found}


def fit(rows: DataFrame, folds: int, s: Settings, checkpoint: str | None = None) -> list[Head]:
    """Fits the heads of all folds side by side. `rows`: id, features, y and splits (array: what the row is to each fold).

    With whole-table steps an epoch is one pass: it gives the gradient of the next step, the scores of the rows trained
    on and, of the step before, the validation. With batches it is a walk and a validation pass. A fold that has stopped
    costs no more. With a `checkpoint` folder every epoch is appended to its table, and a run that was cut short goes on
    after its last epoch; a table of other settings is an error.
    """
    spark = rows.sparkSession
    s.kind  # an unknown loss is an error before any pass
    balance.check_strategy(s.strategy)
    rows = rows.persist()
    try:
        found = rows.select(F.size("features").alias("n")).first()
        if found is None:
            raise ValueError("no rows to fit from")
        dim = found["n"]
        numbers = np.zeros(2 * dim + 2)
        said = json.dumps(asdict(s) | {"epochs": None, "folds": folds, "dim": dim}, sort_keys=True)
        heads = [Head(numbers, numbers, numbers) for _ in range(folds)]
        done = restored(spark, checkpoint, heads, s, said) if checkpoint else 0
        if s.batch_size is not None:
            of = [F.count_if(F.col("splits")[f] == TRAIN).alias(str(f)) for f in range(folds)]
            steps = {f: n // s.batch_size for f, n in enumerate(rows.agg(*of).first())}
        going = lambda: {f: h for f, h in enumerate(heads) if h.waited < s.patience}
        ready = None
        for epoch in range(done + 1, s.epochs + 1):
            live = going()
            if not live:
                break
            if s.batch_size is None:
                sums, scores = ready or gathered(passed(rows, {f: h.theta for f, h in live.items()}, dim, s, epoch, (TRAIN,)))
                for f, head in live.items():
                    own = sums.get((f, TRAIN))
                    if own is not None:
                        head.step(own[2:] / max(own[1], 1e-300), s)
                train = {f: (sums[f, TRAIN][0] / max(sums[f, TRAIN][1], 1e-300) if (f, TRAIN) in sums else 0.0, scores.get((f, TRAIN))) for f in live}
                ready = gathered(passed(rows, {f: h.theta for f, h in live.items()}, dim, s, epoch + 1))
                sums, scores = ready
            else:
                walking = {f: h for f, h in live.items() if steps[f]}
                sums, scores = gathered(walked(rows, walking, steps, dim, s, epoch)) if walking else ({}, {})
                train = {}
                for f, head in live.items():
                    lost = 0.0
                    if (f, STATE) in sums:
                        new = Head.of(sums[f, STATE][:-1])
                        head.theta, head.first, head.second, head.taken = new.theta, new.first, new.second, new.taken
                        lost = sums[f, STATE][-1] / steps[f]
                    train[f] = lost, scores.get((f, TRAIN))
                sums, scores = gathered(passed(rows, {f: h.theta for f, h in live.items()}, dim, s, epoch, (VAL,)))
            records = []
            for f, head in live.items():
                own = sums.get((f, VAL), (0.0, 0.0))
                row = {"epoch": epoch, "train_loss": float(train[f][0]), "val_loss": float(own[0] / max(own[1], 1e-300))}
                for phase, values in (("train", train[f][1]), ("val", scores.get((f, VAL)))):
                    row |= {f"{phase}_{m}": (values or NOTHING)[m] for m in MEASURES}
                better = head.told(row, s)
                records.append(
                    checkpoints.Epoch(f, epoch, head.theta, head.first, head.second, head.taken, head.best, head.waited, better, head.waited >= s.patience, row, s.input_channels, s.use_rgb, said)
                )
            if checkpoint:
                checkpoints.append(spark, checkpoint, records)
    finally:
        rows.unpersist()
    if any(h.model is None for h in heads):
        raise ValueError("no epoch improves")
    return heads


#: Metrics of no rows.
NOTHING = {"recall": 0.0, "specificity": 0.0, "f1": 0.0, "auc": math.nan}


def restored(spark, folder: str, heads: list[Head], s: Settings, said: str) -> int:
    """Brings the heads to where the table ends; the number of its last epoch."""
    past = checkpoints.read(spark, folder)
    if past is None:
        return 0
    if {e.settings for e in past.epochs} != {said}:
        raise ValueError(f"{folder} holds epochs of other settings")
    for f, head in enumerate(heads):
        last = past.last[f]
        head.theta, head.first, head.second = last.theta, last.first, last.second
        head.taken, head.best, head.waited = last.taken, last.best, last.waited
        head.history = [e.row for e in past.epochs if e.fold == f]
        if f in past.best:
            head.model = model_of(past.best[f].theta, past.best[f].epoch, head.best, s)
    return max(e.epoch for e in past.epochs)


def complete(rows: DataFrame) -> DataFrame:
    return rows.where("id is not null and y is not null and features is not null")


def fit_head(train: DataFrame, val: DataFrame, checkpoint: str | None = None, **settings) -> tuple[list[dict], dict]:
    """(history, model): AdamW epochs with validation, best epoch and early stop. `settings`: fields of Settings.

    A step takes all rows; or, with `batch_size`, as many in the order of `strategy` (sampler: drawn with replacement by
    class weights; loss_weights, none: shuffled), a short last batch left out, and the epoch's loss is the mean of its
    batches'. Train metrics are of the scores that the steps' own forward passes gave, before each step.
    `train` and `val`: id long (unique in each), features array, y int (0 or 1); rows with a null among them don't
    count. history is a list of 11-field rows; model has coef, intercept, epoch and best_score of the best epoch, and
    input_channels and use_rgb as given. No epoch that improves is an error.
    """
    s = Settings(**settings)
    role = lambda rows, k: complete(rows).select("id", "features", F.col("y").cast("int").alias("y"), F.array(F.lit(k).cast("tinyint")).alias("splits"))
    head = fit(role(train, TRAIN).union(role(val, VAL)), 1, s, checkpoint)[0]
    return head.history, head.model


def with_roles(rows: DataFrame, assigned: DataFrame) -> tuple[DataFrame, list]:
    """The rows with what each is to every fold, and the folds in order. `assigned`: id, fold, split. A row without a fold's split is nothing to it."""
    folds = sorted(r["fold"] for r in assigned.select("fold").distinct().collect())
    code = F.element_at(F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv]), F.col("split"))
    roles = [F.coalesce(F.min(F.when(F.col("fold") == f, code)), F.lit(NONE)).cast("tinyint") for f in folds]
    by_id = assigned.groupBy("id").agg(F.array(*roles).alias("splits"))
    kept = complete(rows).select("id", "features", F.col("y").cast("int").alias("y"))
    return kept.join(by_id, "id"), folds


def fit_folds(rows: DataFrame, assigned: DataFrame, checkpoint: str | None = None, **settings) -> dict:
    """{fold: (history, model)} of all folds, fitted at once: each row is read once an epoch and feeds every fold that trains on it.

    `rows`: as fit_head's; `assigned`: id, fold, split (train, val, test). Each fold stops by itself, and is what fit_head gives for
    its rows alone.
    """
    table, folds = with_roles(rows, assigned)
    heads = fit(table, len(folds), Settings(**settings), checkpoint)
    return {fold: (head.history, head.model) for fold, head in zip(folds, heads, strict=True)}


def fold_metrics(rows: DataFrame, assigned: DataFrame, models: dict, split: str = "test", level: float = 0.5) -> DataFrame:
    """fold and the metrics of each fold's model on the fold's own `split`, in one pass over all rows."""
    table, folds = with_roles(rows, assigned)
    thetas = {i: np.append(np.ravel(models[f]["coef"]), models[f]["intercept"]) for i, f in enumerate(folds)}
    dim = (len(next(iter(thetas.values()))) - 2) // 2
    counted = passed(table, thetas, dim, Settings(), phases=(SPLITS[split],)).where("at < 0").groupBy("fold", "prob").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    found = metrics.at_level(metrics.summary(counted, {"x": level}, ("fold",)), "x")
    named = F.element_at(F.array(*map(F.lit, folds)), F.col("fold") + 1).alias("fold")
    return found.select(named, *MEASURES, *metrics.COUNTS)


def gradient(rows: DataFrame, model: dict, **settings) -> np.ndarray:
    """Sums over all rows (id, features, y) under a model: loss, weight, gradients of the coefficients and the intercepts."""
    theta = np.append(np.ravel(model["coef"]), model["intercept"])
    table = complete(rows).select("id", "features", F.col("y").cast("int").alias("y"), F.array(F.lit(TRAIN).cast("tinyint")).alias("splits"))
    sums = passed(table, {0: theta}, (len(theta) - 2) // 2, Settings(**settings), phases=(TRAIN,)).where("at >= 0").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(2 + len(theta))
    for r in sums.collect():  # as many numbers as the model has
        out[r["at"]] = r["value"]
    return out


def scored(rows: DataFrame, model: dict) -> DataFrame:
    return scoring.score(rows, model["coef"], model["intercept"]).withColumn("prob", F.col("prob_sick"))


def report(val: DataFrame, test: DataFrame, model: dict, metric: str = "youden_j") -> DataFrame:
    """Tunes the threshold on `val` and evaluates `test` at 0.5 and at it."""
    chosen = threshold.optimize(scored(val, model), metric).first()
    return metrics.evaluation(scored(test, model), chosen["threshold"])
