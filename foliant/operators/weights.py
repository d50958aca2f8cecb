"""Catalogues of model tensors: names by suffix, layer plans, what a model needs, what is missing and whether it may be loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import format_bytes
from foliant.operators.matrices import multiply  # noqa: F401  beside the tensors it multiplies

# Tensor names by role, and the largest load that counts as interactive.
FIRST_NORM = "layers.0.input_layernorm.weight"
COMMON = {"input_norm": "input_layernorm.weight", "post_norm": "post_attention_layernorm.weight", "gate": "mlp.gate_proj.weight", "up": "mlp.up_proj.weight", "down": "mlp.down_proj.weight"}
LINEAR = {
    "qkv": "linear_attn.in_proj_qkv.weight", "z": "linear_attn.in_proj_z.weight", "b": "linear_attn.in_proj_b.weight", "a": "linear_attn.in_proj_a.weight", "conv": "linear_attn.conv1d.weight",
    "dt_bias": "linear_attn.dt_bias", "a_log": "linear_attn.A_log", "norm": "linear_attn.norm.weight", "out": "linear_attn.out_proj.weight",
}
FULL = {"q": "self_attn.q_proj.weight", "k": "self_attn.k_proj.weight", "v": "self_attn.v_proj.weight", "o": "self_attn.o_proj.weight", "q_norm": "self_attn.q_norm.weight", "k_norm": "self_attn.k_norm.weight"}
SHIFTED = r"\.(input_layernorm|post_attention_layernorm|q_norm|k_norm|norm)\.weight$"
INTERACTIVE_BYTES = 256 * 1024 * 1024


def first_by_suffix(manifest: DataFrame, suffix: str | Column, *, by: str = "model") -> DataFrame:
    """(model, name): each model's first tensor, in the manifest's order ``ord``, whose name ends in ``suffix``."""
    fits = F.endswith(F.col("name"), F.lit(suffix) if isinstance(suffix, str) else suffix)
    return manifest.where(fits).groupBy(by).agg(F.min_by("name", "ord").alias("name"))


def text_prefix(manifest: DataFrame) -> DataFrame:
    """(model, prefix): what stands before the first layer's norm; models without one have no row."""
    found = first_by_suffix(manifest, FIRST_NORM)
    return found.select("model", F.expr(f"substring(name, 1, length(name) - {len(FIRST_NORM)})").alias("prefix"))


def number_list(value: Column) -> Column:
    """A JSON number or list as an array of longs; entries that are no numbers go, and so does anything else."""
    listed = F.from_json(F.when(F.startswith(value, F.lit("[")), value).when(F.regexp_like(value, F.lit(r"^-?[0-9]+$")), F.concat(F.lit("["), value, F.lit("]"))).otherwise("[]"), "array<string>")
    whole = F.filter(listed, lambda x: F.regexp_like(x, F.lit(r"^-?[0-9]+$")))
    return F.coalesce(F.transform(whole, lambda x: x.cast("long")), F.array().cast("array<long>"))


def stop_tokens(config: Column, tokenizer_config: Column) -> Column:
    """The end tokens that a model's JSON configuration, its text part and its tokenizer name, each once, in this order."""
    own, text, tok = (number_list(F.get_json_object(c, path)) for c, path in ((config, "$.eos_token_id"), (config, "$.text_config.eos_token_id"), (tokenizer_config, "$.eos_token_id")))
    return F.array_distinct(F.concat(own, text, tok))


def layer_plans(models: DataFrame) -> DataFrame:
    """(model, layer, linear, role, name, ord): the tensors of each layer.

    ``models``: model, prefix, num_hidden_layers, full_attention_interval and (optional) num_experts. Every
    ``full_attention_interval``-th layer has full attention, the others linear attention. Mixtures of experts are refused.
    """
    if "num_experts" in models.columns:
        refused = F.raise_error(F.concat(F.lit("mixtures of experts are not supported: "), F.col("model").cast("string"))).cast("int")
        models = models.withColumn("num_hidden_layers", F.when(F.coalesce("num_experts", F.lit(0)) > 0, refused).otherwise(F.col("num_hidden_layers")))
    some = models.where(F.col("num_hidden_layers") > 0)
    layers = some.select("model", "prefix", "full_attention_interval", F.explode(F.sequence(F.lit(0), F.col("num_hidden_layers") - 1)).alias("layer"))
    layers = layers.withColumn("linear", (F.col("layer") + 1) % F.col("full_attention_interval") != 0)
    roles = lambda table: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("part")) for r, n in table.items()])
    parts = F.concat(roles(COMMON), F.when(F.col("linear"), roles(LINEAR)).otherwise(roles(FULL)))
    each = layers.select("model", "prefix", "layer", "linear", F.posexplode(parts).alias("at", "p"))
    name = F.concat(F.col("prefix"), F.lit("layers."), F.col("layer").cast("string"), F.lit("."), F.col("p.part"))
    return each.select("model", "layer", "linear", F.col("p.role").alias("role"), name.alias("name"), (F.col("layer") * 100 + F.col("at") + 3).cast("int").alias("ord"))


def required_names(models: DataFrame, plans: DataFrame) -> DataFrame:
    """(model, name, ord): every tensor a model needs, once: embedding, last norm and (if it has one) head, then its layers'.

    ``models`` names them in embed_name, final_norm_name and head_name (null: none).
    """
    outer = models.select("model", F.posexplode(F.array("embed_name", "final_norm_name", "head_name")).alias("ord", "name")).where("name is not null")
    return outer.unionByName(plans.select("model", "name", "ord")).groupBy("model", "name").agg(F.min("ord").alias("ord"))


def runtime_status(models: DataFrame, required: DataFrame, manifest: DataFrame, *, most: int = INTERACTIVE_BYTES) -> DataFrame:
    """(model, interactive, reason, cold_start_bytes, cold_start_label): the bytes to load, and the first reason against it."""
    sizes = manifest.groupBy("model", "name").agg(F.max(F.coalesce("byte_length", F.lit(0))).alias("size"))
    met = required.join(sizes, ["model", "name"], "left")
    summed = met.groupBy("model").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"), F.min_by("name", F.when(F.col("size").isNull(), F.col("ord"))).alias("absent"), F.count(F.when(F.col("size").isNull(), 1)).alias("n_absent"))
    out = models.join(summed, "model", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    label = format_bytes(F.col("total"))
    reason = (
        F.when(F.col("head_name").isNull(), "lm-head-unavailable").when(F.col("n_absent") > 0, F.concat(F.lit("missing-tensors:"), F.col("absent")))
        .when(F.col("total") > most, F.concat(F.lit("cold-start-too-large:"), label)).otherwise("interactive-ready")
    )
    return out.select("model", (reason == "interactive-ready").alias("interactive"), reason.alias("reason"), F.col("total").alias("cold_start_bytes"), label.alias("cold_start_label"))


def missing_tensors(required: DataFrame, manifest: DataFrame) -> DataFrame:
    """The required (model, name, ord) that the manifest does not have."""
    return required.join(manifest.select("model", "name").distinct(), ["model", "name"], "left_anti")


def norm_shift(manifest: DataFrame) -> DataFrame:
    """(model, shift): whether stored norm weights are one too small, as names and convolution shapes tell."""
    wide = F.endswith(F.col("name"), F.lit("conv1d.weight")) & (F.size("shape") == 3) & (F.element_at("shape", -1) != 1)
    return manifest.groupBy("model").agg(F.coalesce(F.max(F.contains(F.col("name"), F.lit("mtp.")) | F.coalesce(wide, F.lit(False))), F.lit(False)).alias("shift"))


def shifted_weights(name: Column, values: Column, shift: Column) -> Column:
    """Values as they are used: norm weights plus one in models whose weights are stored shifted."""
    return F.when(shift & F.regexp_like(name, F.lit(SHIFTED)), F.transform(values, lambda x: x + 1)).otherwise(values)


def row_of(values: Column, shape: Column, row: Column) -> Column:
    """A row of a tensor's flat values, by its last dimension; the whole of a vector."""
    width = F.element_at(shape, -1).cast("int")
    return F.when(F.size(shape) == 1, values).otherwise(F.slice(values, (row * width + 1).cast("int"), width))


def conv_kernel_at(values: Column, shape: Column, channel: Column, tap: Column) -> Column:
    """A tap of a depthwise convolution's channel, of weights in two dimensions or three (one of them may be 1)."""
    per_channel = F.aggregate(F.slice(shape, 2, 2), F.lit(1).cast("long"), lambda n, x: n * x)
    known = F.when(F.size(shape).isin(2, 3), per_channel).otherwise(F.raise_error(F.concat(F.lit("no convolution of shape "), F.array_join(shape.cast("array<string>"), "x"))).cast("long"))
    return F.get(values, (channel * known + tap).cast("int"))


def config_summary(config: Column, supported: Column) -> Column:
    """(name, unsupported): a JSON configuration's architecture and the features it needs beyond the ``supported`` ones."""
    names = F.from_json(F.get_json_object(config, "$.architectures"), "array<string>")
    raw = F.coalesce(F.get_json_object(config, "$.text_config.layer_types"), F.get_json_object(config, "$.layer_types"), F.get_json_object(config, "$.model_type"))
    layers = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    needs = F.array_compact(F.array(
        F.when(F.array_contains(layers, "linear_attention"), "linear_attention"),
        F.when(F.exists(names, lambda x: F.contains(x, F.lit("ConditionalGeneration"))), "multimodal-conditional-generation"),
    ))
    name = F.coalesce(F.get(names, F.lit(0)), F.get_json_object(config, "$.model_type"), F.lit("unknown"))
    return F.struct(F.coalesce(name, F.lit("unknown")).alias("name"), F.coalesce(F.array_except(needs, supported), F.array().cast("array<string>")).alias("unsupported"))


# Sizes of the known models; the first stands in for unknown ones.
MODEL_SIZES = [
    ("onnx-community/Qwen3.5-0.8B-ONNX", 1024, 28, 16, 8, 64),
    ("onnx-community/Qwen3.5-2B-ONNX", 1536, 28, 16, 8, 96),
    ("onnx-community/Qwen3.5-4B-ONNX", 2560, 36, 32, 8, 80),
]
SIZE_COLUMNS = ("hidden_size", "num_hidden_layers", "num_attention_heads", "num_key_value_heads", "head_dim")


def model_config(models: DataFrame, name: str = "model_id") -> DataFrame:
    """Add the sizes of each named model; unknown and null names get those of the first."""
    row = lambda sizes: F.struct(*[F.lit(x).alias(c) for c, x in zip(SIZE_COLUMNS, sizes, strict=True)])
    found = F.lit(None)
    for model, *sizes in reversed(MODEL_SIZES):
        found = F.when(F.col(name) == model, row(sizes)).otherwise(found) if model != MODEL_SIZES[0][0] else found
    found = F.coalesce(found, row(MODEL_SIZES[0][1:]))
    return models.withColumn("_sizes", found).select(*models.columns, *[F.col(f"_sizes.{c}").alias(c) for c in SIZE_COLUMNS])


def executor_status(made: Column, error: Column) -> Column:
    """(status, reason) of a pluggable executor: made, left out because its conditions are not met, or failed."""
    status = F.when(error.isNotNull(), "error").when(made, "ready").otherwise("skipped")
    return F.struct(status.alias("status"), F.coalesce(error, F.when(made, "executor-created").otherwise("executor-conditions-not-met")).alias("reason"))


def adapter_summary(adapters: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, layers, bytes, memory, label) of adapters in long form; ``sections``: doc_id, num_groups and encoding_ms."""
    sums = adapters.groupBy("doc_id").agg((F.max("layer") + 1).alias("layers"), (F.count(F.lit(1)) * 4).alias("bytes"))
    kb, mb = F.col("bytes") / 1024, F.col("bytes") / (1024 * 1024)
    memory = F.when(F.col("bytes") < 1024 * 1024, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))
    label = F.concat(
        F.lit("rank=8 · "), F.col("num_groups").cast("string"), F.when(F.col("num_groups") == 1, " section · ").otherwise(" sections · "), F.col("layers").cast("string"), F.lit(" layers · "), F.col("memory"), F.lit(" · "), F.col("encoding_ms").cast("string"), F.lit("ms")
    )
    return sums.join(sections, "doc_id").withColumn("memory", memory).select("doc_id", "layers", "bytes", "memory", label.alias("label"))


def load_order(manifest: DataFrame) -> DataFrame:
    """A manifest with ``ord``, each model's tensors in file and byte order, for sources that have none."""
    return manifest.withColumn("ord", F.row_number().over(Window.partitionBy("model").orderBy("file_path", "byte_start", "name")))
