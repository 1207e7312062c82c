"""Multi-job plans: crawls, and the whole path from pages to search."""
