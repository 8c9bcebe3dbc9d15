"""Column expressions shared by the operators."""

from blotter.functions.calendar import (calendar_for, holiday_calendar,
                                        with_holiday_flags)
from blotter.functions.text import clean_name, parse_vector_text, vector_text
from blotter.functions.timeparts import (iso_weekday, parse_text_date,
                                         parse_text_ts, part, round_minutes,
                                         trunc_hour, with_date_parts)

__all__ = ["calendar_for", "holiday_calendar", "with_holiday_flags", "clean_name",
           "parse_vector_text", "vector_text", "iso_weekday", "parse_text_date",
           "parse_text_ts", "part", "round_minutes", "trunc_hour", "with_date_parts"]
