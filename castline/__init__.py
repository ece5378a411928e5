"""Script analytics as Spark jobs: scripts, cue sheets, edit journals, production logs and asset manifests."""
