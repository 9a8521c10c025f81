"""Progress of running reviews, as batch jobs and streaming queries."""
