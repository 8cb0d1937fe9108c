"""An associative recall engine on Spark: facts in scopes, recalled by overlapping cues."""
