"""Table work on Spark: reading and checking tables, profiling them, finding unusual values, calendars, schedules and
run ledgers. Every operator takes and gives DataFrames."""

from .errors import OperatorError
from .functions.calendar import (Calendar, business_days_between, clock_to_utc, is_business_day, next_business_day,
                                 previous_business_day, shift_business_days)
from .functions.scalars import Clock
from .functions.params import bind, coerce, render, render_path, resolve, sql_literal, with_literals
from .operators.anomalies import Anomalies, detect_anomalies
from .operators.checks import (AllowedValues, CheckResult, ColumnTypes, Conditions, EarlierRun, Freshness, NoMissing,
                               RowCount, RowCountCompared, Unique, broken_rows, check_table, repeated_keys,
                               unread_values)
from .operators.file_checks import check_files
from .operators.ledger import Ledger
from .operators.profile import (Profile, assert_finite, correlations, custom_statistics, finite_or_null, histograms,
                                long_statistics, profile, rows_over_time, rows_per_group, top_values, wide_statistics)
from .operators.python_code import Step, map_batches, per_group, run_python
from .operators.ranges import range_totals, threshold_totals
from .operators.relational import (asof_join, attach, for_each_row, merge_lines, preview, range_join, route, route_rows,
                                   scrub, status_rollup)
from .operators.schedules import (cron_due, due_instants, due_times, every_due, misfire, missed_runs, once_due,
                                  overlapping_runs, parse_cron)
from .operators.sql import dedupe_columns, run_sql, transform
from .sources.files import (as_table, format_of, list_files, materialise, read_table, with_row_number, write_table)
from .sources.jdbc import normalise_jdbc_types, query_options, read_query
from .sources.records import records_of_text, records_to_table, table_to_records
from .streaming.pickup import Pickup
