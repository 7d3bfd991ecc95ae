"""Citation checking as DataFrame pipelines. The names below are what most users need."""

from refsift.operators.reporting import final_summary, issues, issues_report, report_lines, result_json, run_report, status_counts, tee, written
from refsift.operators.worklist import missing_keys, unused_entries, work_list
from refsift.plans.engine import check, check_observations, observe
from refsift.plans.registry import DEFAULT_SOURCES, Source, sources
from refsift.sources.bibtex import entries_of, read_bib
from refsift.sources.latex import document_keys, read_tex
from refsift.sources.records import function_answers, read_record_lines, read_records, record_answers

__all__ = [
    "DEFAULT_SOURCES", "Source", "check", "check_observations", "document_keys", "entries_of", "final_summary", "function_answers", "issues", "issues_report", "missing_keys", "observe",
    "read_bib", "read_record_lines", "read_records", "read_tex", "record_answers", "report_lines", "result_json", "run_report", "sources", "status_counts", "tee", "unused_entries", "work_list", "written",
]
