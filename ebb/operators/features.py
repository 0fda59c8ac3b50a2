"""Feature engineering (E1-E9) as a fit / transform pair.

``FeatureEngineer.fit(df)`` runs a bounded number of jobs whatever the data
size, and returns a ``FeatureModel`` holding a few numbers per column:

1. one aggregation: HyperLogLog distinct counts of the categorical columns;
2. one ``(column, value)`` count job restricted to the low-cardinality columns
   (at most a few dozen rows reach the driver);
3. one grouped exact-quantile job for the 99 % clip of every ratio feature;
4. one aggregation for mean and population std of every feature.

``FeatureModel.transform(df)`` is a single projection: ratio, encodings and
scaling are literal column expressions, so scoring new data reuses the fit.

Kept from the reference: ratio pairs found by name, 99 % clip of ratios over
the non-null ratios, binary columns as sorted ordinal codes (unseen -1),
one-hot with the first sorted category dropped, nulls filled with 0 before
population-std scaling (zero std divides by 1).
Changed (see README): id columns are matched on whole name tokens, and a null
category is the explicit ``MISSING`` rather than the string ``"nan"``.
"""

from __future__ import annotations

import itertools
import re

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions import fixed as X
from ..functions.exprs import col, is_numeric_type, norm_name
from ..functions.quantiles import DEFAULT_ACCURACY, quantiles

MISSING = "MISSING"


def id_columns(columns: list[str], target: str) -> list[str]:
    """Key-like columns: a fixed id name, or a name with an ``id`` token."""
    out = []
    for c in columns:
        n = norm_name(c)
        if c != target and (n in X.ID_PATTERNS or "id" in n.split("_")):
            out.append(c)
    return out


#: (numerator role, denominator role, infix, skip when the plain name exists).
RATIO_RULES = (("contacts", "tenure", "per", False), ("revenue", "orders", "per", True),
               ("returns", "orders", "to", False))
#: Role -> pattern of column names.
RATIO_ROLES = {"contacts": r"ticket|call", "tenure": r"tenure", "revenue": r"revenue|charges",
               "orders": r"order|transaction", "returns": r"^(?!.*rate).*return"}


def ratio_pairs(columns: list[str], numeric: list[str]) -> list[tuple[str, str, str]]:
    """(numerator, denominator, name): every pair of numeric columns whose
    roles a rule combines."""
    taken = set(map(str.lower, columns))
    of_role = {role: [c for c in numeric if re.search(rx, c.lower())] for role, rx in RATIO_ROLES.items()}
    return [(top, bottom, f"ratio_{top}_{infix}_{bottom}")
            for over, under, infix, unless_there in RATIO_RULES
            for top, bottom in itertools.product(of_role[over], of_role[under])
            if not (unless_there and f"{top}_{infix}_{bottom}" in taken)]


def one_hot_names(onehot: dict[str, list[str]], taken: list[str]) -> dict[tuple[str, str], str]:
    """(column, category) -> ``column_category``, with underscores at the end
    where another column or feature has that name (names differ by more than case)."""
    used, out = {t.lower() for t in taken}, {}
    for c, levels in onehot.items():
        for level in levels[1:]:
            name = f"{c}_{level}"
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            out[c, level] = name
    return out


def _as_category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


@dataclass
class FeatureModel:
    target: str
    keys: list[str]
    ratios: list[tuple[str, str, str, float]]      # num, den, name, q99
    binary: dict[str, list[str]]                    # column -> sorted categories
    onehot: dict[str, list[str]]                    # column -> sorted categories
    numeric: list[str]                              # numeric source columns used
    features: list[str]                             # output order
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    scaled: bool = True

    # -- expressions ----------------------------------------------------------
    def _raw(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in self.numeric:
            out[c] = col(c).cast("double")
        for c, cats in self.binary.items():
            v = _as_category(col(c))
            code = F.lit(-1.0)
            for i, cat in reversed(list(enumerate(cats))):
                code = F.when(v == cat, F.lit(float(i))).otherwise(code)
            out[c] = code
        for num, den, name, q99 in self.ratios:
            r = F.try_divide(col(num).cast("double"),
                             F.when(col(den) != 0, col(den).cast("double")))
            r = F.coalesce(r, F.lit(0.0))
            out[name] = F.when(r < 0, F.lit(0.0)).when(r > F.lit(q99), F.lit(q99)).otherwise(r) \
                if q99 is not None else F.when(r < 0, F.lit(0.0)).otherwise(r)
        names = one_hot_names(self.onehot, [*self.keys, self.target, *out])
        for c, cats in self.onehot.items():
            v = _as_category(col(c))
            for cat in cats[1:]:
                out[names[c, cat]] = F.when(v == cat, F.lit(1.0)).otherwise(F.lit(0.0))
        return out

    def filled_exprs(self) -> dict[str, Column]:
        raw = self._raw()
        return {f: F.coalesce(raw[f], F.lit(0.0)) for f in self.features}

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Keys, features (standardised when fitted so) and the target if present."""
        exprs = self.filled_exprs()
        cols = [col(k) for k in self.keys if k in df.columns]
        for f in self.features:
            e = exprs[f]
            if self.scaled and f in self.scale:
                mean, std = self.scale[f]
                e = (e - F.lit(mean)) / F.lit(std if std != 0 else 1.0)
            cols.append(e.alias(f))
        if self.target in df.columns:
            cols.append(col(self.target))
        for k in keep or []:
            cols.append(col(k))
        return df.select(*cols)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> "FeatureModel":
        d = json.loads(s)
        d["ratios"] = [tuple(r) for r in d["ratios"]]
        d["scale"] = {k: tuple(v) for k, v in d["scale"].items()}
        return FeatureModel(**d)


@dataclass
class FeatureEngineer:
    target: str = "churned"
    encode_categorical: bool = True
    scale_numeric: bool = True
    max_categories: int = X.MAX_ONEHOT_CATEGORIES
    accuracy: int = DEFAULT_ACCURACY

    def fit(self, df: DataFrame) -> FeatureModel:
        cols = df.columns
        ids = id_columns(cols, self.target)
        skip = set(ids) | {self.target}
        numeric = [c for c in cols if c not in skip and is_numeric_type(df.schema[c].dataType)]
        cats = [c for c in cols if c not in skip
                and isinstance(df.schema[c].dataType, (StringType, BooleanType))]

        # 1-2: cardinality by sketch, exact categories only for small columns
        binary, onehot, dropped = {}, {}, []
        if cats:
            approx = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in cats]).first()
            small = [c for c in cats if approx[c] <= 2 * self.max_categories]
            values: dict[str, list] = {c: [] for c in small}
            if small:
                long = df.select(F.explode(F.array(*[
                    F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
                    for c in small])).alias("kv")).select("kv.column", "kv.value")
                for r in long.groupBy("column", "value").count().collect():
                    values[r["column"]].append(r["value"])
            for c in cats:
                if c not in values:
                    dropped.append(f"{c} (high cardinality: ~{approx[c]})")
                    continue
                nonnull = [v for v in values[c] if v is not None]
                if len(nonnull) > self.max_categories:
                    dropped.append(f"{c} (high cardinality: {len(nonnull)})")
                    continue
                if not self.encode_categorical:
                    continue
                levels = sorted({v if v is not None else MISSING for v in values[c]})
                (binary if len(nonnull) <= 2 else onehot)[c] = levels

        pairs = ratio_pairs(cols, numeric)
        q99 = {}
        if pairs:
            long = df.select(F.explode(F.array(*[
                F.struct(F.lit(name).alias("column"),
                         F.try_divide(col(num).cast("double"),
                                      F.when(col(den) != 0, col(den).cast("double"))).alias("v"))
                for num, den, name in pairs])).alias("kv")).select("kv.column", "kv.v")
            for r in quantiles(long, "v", [X.RATIO_CLIP_Q], by=["column"],
                               accuracy=self.accuracy, broadcast_groups=True, empty_groups=False).collect():
                q99[r["column"]] = r["edges"][0] if r["edges"] else None
        ratios = [(n, d, name, q99.get(name)) for n, d, name in pairs
                  if name.lower() not in {c.lower() for c in cols}]     # a column of that name is the feature

        # output order: numeric and binary columns in table order, ratios, one-hot
        ordered = [c for c in cols if c in numeric or c in binary]
        features = ordered + [name for _, _, name, _ in ratios]
        features += one_hot_names(onehot, [*ids, self.target, *features]).values()
        model = FeatureModel(self.target, ids, ratios, binary, onehot, numeric, features,
                             dropped=dropped, scaled=self.scale_numeric)
        if self.scale_numeric and features:
            exprs = model.filled_exprs()
            row = df.agg(*[F.avg(exprs[f]).alias(f"m{i}") for i, f in enumerate(features)],
                         *[F.stddev_pop(exprs[f]).alias(f"s{i}") for i, f in enumerate(features)]).first()
            model.scale = {f: (row[f"m{i}"], row[f"s{i}"] or 0.0) for i, f in enumerate(features)}
        return model


def engineer_features(df: DataFrame, target_col: str = "churned", encode_categorical: bool = True,
                      scale_numeric: bool = True) -> tuple[DataFrame, list[str], FeatureModel]:
    """(X with keys and target, feature names, fitted model)."""
    model = FeatureEngineer(target_col, encode_categorical, scale_numeric).fit(df)
    return model.transform(df), model.features, model
