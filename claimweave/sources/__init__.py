"""claimweave.sources"""
