"""Where documents come from: event lines, log files, dated tables."""
