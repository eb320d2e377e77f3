"""Change-forensics analytics on Spark: ranking suspect changes, reading diffs, matching findings, usage and delivery reports."""
