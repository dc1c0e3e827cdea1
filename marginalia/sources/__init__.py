"""Inputs: files, crawled pages, stored search responses."""
