"""First look at a table: clean it, profile it, chart it, query it, model it. All on Spark."""

from .models.problem import detect_problem, suggest_model
from .models.results import Results
from .models.train import comparison_figure, train_models
from .operators.adhoc import run_query
from .operators.breakdowns import breakdowns
from .operators.charts import chart_points, figure, ordered_points
from .operators.clean import clean, drop_duplicates, fill_missing
from .operators.correlations import correlations
from .operators.describe import describe
from .operators.insights import insights
from .operators.sample import exact_sample
from .operators.sessions import parse_replies, prompts, recent_history
from .operators.stats import column_stats, numeric_stats, overview
from .operators.suggest import chart_specs, suggest_charts
from .operators.trends import trends
from .operators.types import infer_types
from .plans.written import written
from .sources.csv import read_csv, write_csv
from .sources.datasets import Datasets, write_report
from .sources.records import preview, records

__all__ = [
    "Datasets", "Results", "breakdowns", "chart_points", "chart_specs", "clean", "column_stats", "comparison_figure",
    "correlations", "describe", "detect_problem", "drop_duplicates", "exact_sample", "figure", "fill_missing", "infer_types",
    "insights", "numeric_stats", "ordered_points", "overview", "parse_replies", "preview", "prompts", "read_csv",
    "recent_history", "records", "run_query", "suggest_charts", "suggest_model", "train_models", "trends", "write_csv",
    "write_report", "written",
]
