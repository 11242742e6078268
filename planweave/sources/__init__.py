"""planweave.sources"""
