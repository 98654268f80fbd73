"""The stages in their order, DataFrames in and DataFrames out; nothing runs until a caller writes or collects."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernels import particles, simplex
from ..operators import constraints, dated_priors, evidence, model_reports, preprocess, signatures
from . import models, priors

ORDER = ("preprocessing", "priors", "likelihood", "baseline")
ALIASES = {"prep": "preprocessing", "preprocess": "preprocessing", "prior": "priors", "deconvolution": "likelihood", "evidence": "baseline"}


def selected_stages(names: list[str] | None) -> list[str]:
    """Canonical names in the pipeline's order, each once; all of them without a choice."""
    wanted = {ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names or ORDER}
    unknown = wanted - {*ORDER, "forecast"}
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [s for s in (*ORDER, "forecast") if s in wanted]


def run(raw: DataFrame, raw_signatures: DataFrame, stages: list[str] | None = None, prior_settings: priors.Settings | None = None, share_settings: simplex.Settings | None = None, forecast_settings: particles.Settings | None = None, lineages: DataFrame | None = None, dated: DataFrame | None = None, carry: bool = False, prior_only: bool = False) -> dict[str, DataFrame]:
    """Tables by name. dated: priors by date (operators.dated_priors) for the shares, carry: they hold until the next one, prior_only: shares of the priors alone. The cleaned counts feed every stage: callers that write several tables should cache `snv` first."""
    out: dict[str, DataFrame] = {}
    chosen = selected_stages(stages)
    snv = out["snv"] = preprocess.with_fractions(preprocess.coerced_counts(raw))
    sig = out["signatures"] = signatures.normalized_signatures(raw_signatures)
    if "preprocessing" in chosen:
        out |= {"coverage_summary": preprocess.coverage_summary(snv), "lod_summary": preprocess.lod_summary(snv), "bias_loci": preprocess.bias_loci(snv), "mutation_prevalence": preprocess.mutation_prevalence(snv), "mutation_entropy": preprocess.mutation_entropy(snv), "mutation_variance": preprocess.mutation_variance(snv), "mutation_missingness": preprocess.mutation_missingness(snv), "overdispersion": preprocess.overdispersion_moments(snv), "schema_validation": constraints.validated({"snv": snv, "signatures": sig} | ({} if lineages is None else {"lineages": lineages}))}
        out |= {"feature_store_snv": snv, "feature_store_signatures": sig.select("mutation", "lineage", "weight")} | ({} if lineages is None else {"feature_store_lineages": constraints.lineage_store(lineages)})
    if "priors" in chosen or "likelihood" in chosen:
        detail = models.prior_detail(snv, prior_settings)
        hyper = models.hyperparameters(detail)
        if "priors" in chosen:
            out |= {"priors_full_detail": detail.filter("kind = 'row'").drop("kind"), "priors_hyperparams": hyper, "detail_global_timeseries": models.global_series(detail, snv), "eb_population_prior": models.population_prior(hyper)}
        if "likelihood" in chosen:
            matrix = signatures.signature_matrix(sig, hyper)
            base = models.resolved_priors(hyper, matrix)
            days = dated_priors.prior_only_days(snv.join(matrix, "mutation", "left_semi"), dated) if prior_only else None
            by_date = None if dated is None else dated_priors.resolved_by_date(snv if days is None else days, base, dated, carry)
            tagged = models.site_shares(snv, matrix, base, share_settings, by_date, days)
            theta, resid = tagged.filter("kind = 'theta'").select("site_id", "date", "lineage", "theta", "theta_sd"), tagged.filter("kind = 'residual'")
            out |= {"theta_estimates": theta.drop("theta_sd"), "theta_uncertainty": models.calibrated_uncertainty(theta.drop("theta"), resid), "residuals": models.z_scores(resid)}
    if "baseline" in chosen:
        scores = evidence.evidence(snv)
        out |= {"baselines_detailed": evidence.posteriors(scores), "bayes_factors_full": evidence.bayes_factors(scores)}
    if "forecast" in chosen:
        matrix = signatures.signature_matrix(sig, snv, use_global=True)
        phi = model_reports.dispersions(out["priors_hyperparams"], matrix) if "priors_hyperparams" in out else 200.0
        out["forecast"] = models.site_forecasts(snv, matrix, phi, forecast_settings, out.get("theta_estimates"))
    return out
